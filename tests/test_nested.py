"""Nested records as flat tables: links, shapes, nulls, empty tables, extra columns."""

import json
import random

from pyspark.sql import functions as F

from planloom.operators.nested import json_variant, merged_schema, relationalize, relationalize_declared, shape_of, split_fields
from planloom.plans.nested_plans import plan_documents, plan_nodes, plan_tables
from planloom.plans.schemas import PLAN

TYPED = f"plan_key bigint, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in PLAN.fields)}, node_id string, v string"
RAW = "plan_key bigint, plan_data string, model string, plan string"


def ref(source, value=None, call=None):
    return (source, value, call, None, None, None, None, None)


def nodes(spark, typed=(), raw=()):
    t = spark.createDataFrame(list(typed), TYPED)
    r = spark.createDataFrame(list(raw), RAW)
    return sorted(map(tuple, plan_nodes(t, r).collect()))


def test_links_go_to_the_last_earlier_call(spark):
    calls = [("a", "L1", {"x": ref("quantity", 1.0)}, None), ("a", "L2", {"x": ref("call_output", None, "a")}, None), ("b", "L3", {"x": ref("call_output", None, "a"), "y": ref("call_output", None, "b")}, None)]
    got = nodes(spark, [(1, calls, ref("call_output", None, "a"), "n", "v")])
    assert got == sorted([
        (1, "call", 0, "", -1), (1, "call", 1, "", -1), (1, "call", 2, "", -1),
        (1, "binding", 0, "x", -1), (1, "binding", 1, "x", 0), (1, "binding", 2, "x", 1), (1, "binding", 2, "y", -1), (1, "final", -1, "", 1),
    ])


def test_nulls_and_repeats_of_typed_plans(spark):
    rows = [
        (1, None, None, None, None), (1, None, None, None, None), (2, [], ref("constant", 1.0), None, None), (None, [("a", "L", None, None)], None, None, None),
        (3, [(None, None, None, None), ("c", "L", {"s": None}, None)], ref("call_output", None, None), None, None),
    ]
    assert nodes(spark, rows) == sorted([(2, "final", -1, "", -1), (3, "call", 0, "", -1), (3, "call", 1, "", -1), (3, "binding", 1, "s", -1), (3, "final", -1, "", -1)])


def test_texts_in_many_shapes(spark):
    calls = [{"call_id": "c0", "sub_id": "L1", "bindings": {"a": 3.0}}, {"call_id": "c1", "sub_id": "L2", "bindings": [{"slot": "b", "source": "call_output", "call_id": "c0"}]}]
    want = [("call", 0, "", -1), ("call", 1, "", -1), ("binding", 0, "a", -1), ("binding", 1, "b", 0), ("final", -1, "", 1)]
    plan = {"calls": calls, "final": {"source": "call_output", "call_id": "c1"}}
    texts = [
        json.dumps(plan), json.dumps({"plan": plan}), json.dumps({"run": 1, "plan_data": plan}), f"Here:\n{json.dumps(plan)}\nDone.", f"```json\n{json.dumps(plan, indent=1)}\n```",
        json.dumps(plan | {"calls": json.dumps(calls)}), json.dumps(plan)[:-20], "", None, "no plan", "{}", "null", "[]",
    ]
    raw = [(i, x, None, "clash") for i, x in enumerate(texts)] + [(0, texts[0][:30], None, None), (1, texts[1], None, None)]
    assert nodes(spark, [], raw) == sorted((k, *n) for k in range(6) for n in want)


def test_empty_tables(spark):
    assert nodes(spark) == []


def test_long_plan(spark):
    n = 300
    calls = [(f"c{i}", "L1", {"x": ref("call_output", None, f"c{i - 1}")}, None) for i in range(n)]
    got = nodes(spark, [(7, calls, ref("call_output", None, "c5"), None, None)])
    assert [r[4] for r in got if r[1] == "binding"] == [-1, *range(n - 1)] and got[-1] == (7, "final", -1, "", 5)


def test_parents_and_ordinals_link_every_level(spark):
    doc = {"a": [{"b": [{"c": 1}, {"c": 2}], "n": "x"}, {"b": None}], "o": {"p": 1, "q": {"r": True}}}
    df = spark.createDataFrame([("k", json.dumps(doc), "clash")], "key string, t string, node_id string").select("key", json_variant(F.col("t")).alias("v"), "node_id")
    t = relationalize(df, "key", "v")
    assert set(t) == {"root", "a", "a.b"}
    root, a, b = t["root"].first(), t["a"].orderBy("a_pos").collect(), t["a.b"].orderBy("b_pos").collect()
    assert (root.o_p, root.o_q_r) == (1, True)
    assert [x.parent_id for x in a] == [root.node_id] * 2 and [x.a_pos for x in a] == [0, 1]
    assert [(x.parent_id, x.a_pos, x.b_pos, x.c) for x in b] == [(a[0].node_id, 0, 0, 1), (a[0].node_id, 0, 1, 2)]


def test_maps_are_declared_and_not_guessed(spark):
    rows = [(i, json.dumps({"m": {f"k{i}_{j}": j for j in range(20)}})) for i in range(5)]
    df = spark.createDataFrame(rows, "key int, t string").select("key", json_variant(F.col("t")).alias("v"))
    t = relationalize(df, "key", "v", maps=("m",))
    assert t["m"].count() == 100 and set(t["m"].columns) >= {"m_key", "m_pos", "scalar"}
    assert set(relationalize(df, "key", "v")) == {"root"} and len(relationalize(df, "key", "v")["root"].columns) >= 100


def plain_value(x):
    return x if x is None or isinstance(x, str) else json.dumps(x)


def rebuilt(tables, keys):
    """Records from their flat tables: the leaves of each by their path of ordinals and names."""
    out = {k: {} for k in keys}
    above = {r.node_id: () for r in tables["root"].collect()}
    for name in sorted(tables, key=lambda n: n.count(".")):
        for r in tables[name].collect():
            d = r.asDict()
            if name != "root":
                level = d["node_id"][len(d["parent_id"]) + 1 :]
                above[d["node_id"]] = (*above[d["parent_id"]], *level.split("/"))
            path = above[d["node_id"]]
            own = {c: v for c, v in d.items() if c not in ("key", "node_id", "parent_id") and not c.endswith(("_pos", "_key", "_present")) and v is not None}
            out[d["key"]] |= {(*path, c): plain_value(v) for c, v in own.items()}
    return out


def leaves(x, path=(), prefix=""):
    """What ``rebuilt`` is to give, read off the record itself."""
    found = {}
    if isinstance(x, dict):
        for k, v in x.items():
            if isinstance(v, dict):
                found |= leaves(v, path, f"{prefix}{k}_")
            elif isinstance(v, list):
                for i, e in enumerate(v):
                    found |= leaves(e, (*path, prefix.replace("_", ".") + k, str(i)))
            elif v is not None:
                found[(*path, prefix + k)] = plain_value(v)
    elif isinstance(x, list):
        for i, e in enumerate(x):
            found |= leaves(e, (*path, "element", str(i)))
    elif x is not None:
        found[(*path, "scalar")] = plain_value(x)
    return found


def test_records_can_be_rebuilt_from_their_tables(spark):
    rng = random.Random(3)
    leaf = lambda: rng.choice([None, f"s{rng.randint(0, 9)}"])
    several = lambda f, n=3: [f() for _ in range(rng.randint(0, n))]

    def record():
        kid = lambda: {"c": leaf(), "deep": several(leaf)}
        cell = lambda: rng.choice([leaf, lambda: several(leaf)])()
        mixed = lambda: rng.choice([leaf, lambda: several(leaf), lambda: {"z": leaf()}])()
        r = {"a": leaf(), "o": {"b": leaf(), "kids": several(kid)}, "rows": several(lambda: several(cell)), "mixed": several(mixed)}
        return {k: v for k, v in r.items() if rng.random() < 0.9}

    records = [record() for _ in range(60)]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "key int, t string").select("key", F.try_parse_json("t").alias("v"))
    assert rebuilt(relationalize(df, "key", "v"), range(60)) == {k: leaves(r) for k, r in enumerate(records)}


def test_arrays_of_arrays_are_levels_in_both_ways(spark):
    rows = [(1, ([["a", None], None, []], {"k": [["x"], ["y", "z"]]})), (2, (None, None)), (3, ([], {}))]
    df = spark.createDataFrame(rows, "key int, v struct<grid: array<array<string>>, m: map<string, array<array<string>>>>")
    declared = relationalize_declared(df, "key", "v")
    inferred = relationalize(df.select("key", F.to_variant_object("v").alias("v")), "key", "v", like=df.schema["v"].dataType)
    for t in (declared, inferred):
        assert set(t) == {"root", "grid", "grid.element", "m", "m.element", "m.element.element"}
        assert sorted((r.key, r.grid_pos, r.element_pos, r.scalar, r.parent_id) for r in t["grid.element"].collect()) == [(1, 0, 0, "a", "1/grid/0"), (1, 0, 1, None, "1/grid/0")]
        assert sorted((r.m_key, r.element_pos, r.m_element_element_pos, r.scalar) for r in t["m.element.element"].collect()) == [("k", 0, 0, "x"), ("k", 1, 0, "y"), ("k", 1, 1, "z")]
        assert [r.scalar for r in t["grid"].collect()] == [None] * 3


def test_fields_of_types():
    assert split_fields("OBJECT<a: ARRAY<OBJECT<x: BIGINT, y: STRING>>, `b, c`: DECIMAL(3,1)>") == {"a": "ARRAY<OBJECT<x: BIGINT, y: STRING>>", "b, c": "DECIMAL(3,1)"}
    s = shape_of("OBJECT<a: ARRAY<BIGINT>, b: VARIANT, c: DECIMAL(3,1)>")
    assert s.children == {"a": "ARRAY<BIGINT>", "b": "VARIANT"} and s.scalars == {"b": "string", "c": "double"}


def test_schema_of_nothing(spark):
    df = spark.createDataFrame([], "t string").select(F.try_parse_json("t").alias("v"))
    assert merged_schema(df, "v") == "VOID"


def test_surrogate_keys_are_unique(spark):
    calls = [("a", "L1", {"x": ref("constant", 1.0), "y": ref("constant", 2.0)}, None)] * 3
    docs = plan_documents(spark.createDataFrame([(1, calls, None, None, None), (2, calls, ref("constant", 1.0), None, None)], TYPED))
    t = plan_tables(docs)
    ids = [r.node_id for name in ("calls", "bindings", "finals") for r in t[name].collect()]
    assert len(ids) == len(set(ids)) == 6 + 12 + 1
    assert {r.parent_id for r in t["bindings"].collect()} == {r.node_id for r in t["calls"].collect()}


def test_declared_and_inferred_give_the_same_tables(spark):
    calls = [("a", "L1", {"x": ref("quantity", 1.5), "y": ref("call_output", None, "a")}, (2.0, "int", None)), (None, "L2", None, None), ("b", None, {}, None)]
    df = spark.createDataFrame([(1, calls, ref("constant", 2.0), None, None), (2, [], None, None, None), (3, None, ref("call_output", None, "b"), None, None)], TYPED)
    struct = df.select("plan_key", F.struct("calls", "final").alias("plan"))
    inferred = relationalize(struct.select("plan_key", F.to_variant_object("plan").alias("plan")), "plan_key", "plan", like=PLAN)
    declared = relationalize_declared(struct, "plan_key", "plan")
    assert set(inferred) == set(declared) == {"root", "calls", "calls.bindings"}
    for name, a in declared.items():
        b = inferred[name]
        cols = sorted(set(a.columns) - {"scalar", "node_id", "calls_bindings_pos", "bindings_pos"})  # maps have no order of their own
        assert set(a.columns) == set(b.columns) and sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect())), name


def test_arrays_within_objects_have_tables(spark):
    kind = "struct<m:struct<tokens:array<string>,n:bigint,o:struct<tokens:array<struct<x:bigint>>>>,tokens:array<string>>"
    rows = [(1, ((["a", "b"], 1, ([(7,)],)), ["t"])), (2, None), (3, ((None, 2, None), None))]
    df = spark.createDataFrame(rows, f"k bigint, v {kind}")
    declared = relationalize_declared(df, "k", "v")
    inferred = relationalize(df.select("k", F.to_variant_object("v").alias("v")), "k", "v")
    for tables in (declared, inferred):
        assert set(tables) == {"root", "tokens", "m.tokens", "m.o.tokens"}
        assert sorted((r.k, r.m_tokens_pos, r.scalar, r.parent_id, r.node_id) for r in tables["m.tokens"].collect()) == [(1, 0, "a", "1", "1/m.tokens/0"), (1, 1, "b", "1", "1/m.tokens/1")]
        assert [(r.k, r.m_o_tokens_pos, r.x) for r in tables["m.o.tokens"].collect()] == [(1, 0, 7)]
        assert [(r.k, r.tokens_pos, r.scalar) for r in tables["tokens"].collect()] == [(1, 0, "t")]
