"""Features, libraries, metrics, templates, search, files, streams on small fixtures; all SQL pairs on the smallest data."""

import datetime
import importlib
import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from planloom import queries as core
from planloom import audit_queries, record_queries  # noqa: F401 - they register their queries
from planloom.functions import text
from planloom.operators import evolve, features, library, metrics, search, templates
from planloom.plans.programs import Program, Slot, Step
from planloom.plans.schemas import CALL, PLAN, PROGRAM, STEP
from planloom.sources import files
from planloom.streaming import funnels

DATA = "/root/testdata/sf0.001"
REF = ("constant", 1.0, None, None, None, None, None, None)


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = core.QUERIES[name](spark, DATA)
    rel = con.sql(core.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=order)
    assert got == want


def calls(spark, rows):
    return features.plan_calls(spark.createDataFrame(rows, f"plan_key bigint, calls array<{CALL.simpleString()}>, sub string"))


def test_compounds_of_a_plan(spark):
    rows = [(1, [("c0", "A", {"x": REF}, None), ("c1", "B", {"x": ("call_output", None, "c0", None, None, None, None, None)}, None), ("c2", "C", {"x": REF}, None)], "clash"), (2, None, None), (3, [], None), (None, None, None)]
    c = calls(spark, rows)
    found = {r.compound for r in features.compounds(c).collect()}
    assert {"bigram:A>B", "bigram:B>C", "trigram:A>B>C", "flow:A->B", "bind_flow:A>C:x", "total_calls:3", "arity_pair:1>1"} <= found
    true = {r.compound for r in features.true_flow(c).collect()}
    assert {"true_flow:A>B", "flow_slot:A>B.x", "multicall:3"} <= true and not any("B>C" in x for x in true)
    empty = calls(spark, [])
    assert features.compounds(empty).count() == features.true_flow(empty).count() == 0
    assert features.tvd(features.atoms(empty), F.col("plan_key") > 0).first()[0] == 1.0


def test_split_covers_all_plans_once(spark):
    c = calls(spark, [(i, [("c", f"L{i % 5}", {"x": REF}, None)] * (1 + i % 3), None) for i in range(60)])
    rows = features.constrained_split(c, trials=5).collect()
    assert sorted(r.plan_key for r in rows) == list(range(60)) and {r.split for r in rows} == {"train", "dev", "test"}


def program(expr, *names):
    return ("p", [(n, "float", None) for n in names], [("compute", "t", expr, list(names), "float"), ("output", "t", "t", ["t"], "float")], None)


def test_library_operators(spark):
    rows = [(i, [("a", "float", None), ("b", "float", None)], program("a + b", "a", "b")[2], "s") for i in range(3)] + [(3, None, None, None), (4, [], [], None)]
    p = spark.createDataFrame(rows, f"row_id bigint, slots array<struct<name:string,dtype:string,description:string>>, steps array<{STEP.simpleString()}>, source string")
    assert {(r.support, r.first_id) for r in library.add_all(p).collect()} == {(2, 0), (0, 4)}
    assert [(r.support, r.main_source, r.first_id) for r in library.mine_whole(p).collect()] == [(3, "s", 0)]
    assert [(r.canonical, r.support) for r in library.step_primitives(p).collect()] == [("a0 + a1", 3)]
    lib = spark.createDataFrame([("L2", program("a + b", "a", "b"), 5, 1.0), ("L1", program("x * y", "x", "y"), None, None), (None, None, 1, 1.0)], f"sub_id string, program {PROGRAM.simpleString()}, support bigint, mdl_gain double")
    cover = {r.row_id: (r.cover, r.covered) for r in library.greedy_cover(p, lib).collect()}
    assert cover == {0: ("L1", 1), 1: ("L1", 1), 2: ("L1", 1), 4: ("", 0)}
    assert library.greedy_cover(p, lib.where("false")).where("covered > 0").count() == 0
    assert library.next_id(lib).first()[0] == 3 and library.prune(lib, 2, 0.5).count() == 1
    assert metrics.compression(p, library.greedy_cover(p, lib)).first().n == 3


def test_renaming_never_renames_twice(spark):
    df = spark.createDataFrame([("b + a * ab", ["a", "b"])], "e string, i array<string>")
    assert df.select(library.canonical_step(F.col("e"), F.col("i"))).first()[0] == "a1 + a0 * ab"
    swap = spark.createDataFrame([("a1 + a0", ["a1", "a0"])], "e string, i array<string>")
    assert swap.select(library.canonical_step(F.col("e"), F.col("i"))).first()[0] == "a0 + a1"


def test_votes_and_pass_at_k(spark):
    df = spark.createDataFrame([("q", "x", 2, False), ("q", "y", 1, True), ("q", None, 0, None), ("r", None, 3, False)], "k string, a string, i int, c boolean")
    assert [(r.k, r.a, r.votes) for r in metrics.majority(df, "k", "a", "i").collect()] == [("q", "y", 1)]
    ok = F.coalesce("c", F.lit(False))
    assert metrics.pass_at_k(df, "k", ok, 1).first().pass_at_k == pytest.approx((1 / 3 + 0) / 2)
    assert metrics.pass_at_k(df, "k", ok, 2).first().pass_at_k == pytest.approx((1 - (2 / 3) * (1 / 2) + 0) / 2)
    assert metrics.pass_at_k(df.where("false"), "k", ok, 2).first().n_keys == 0


def test_regression_finds_the_line(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), ((F.col("id") * 7) % 13).cast("double").alias("z"), (3.0 * F.col("id") + 1).alias("y"), F.lit(1.0).alias("one"))
    r = {x.predictor: x for x in metrics.regression(df, "y", ["x", "z", "one"]).collect()}
    assert r["x"].beta == pytest.approx(1, abs=1e-5) and r["x"].r2 == pytest.approx(1, abs=1e-5) and r["one"].beta == 0
    assert metrics.regression(df.where("false"), "y", ["x"]).first().n == 0


def test_dynamic_memory_against_a_loop(spark):
    rows = [(i, ("a", "b", None)[i % 3], i % 5 == 0, float(i % 5), float((i * 7) % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, key string, t boolean, u double, v double")
    seen, total, reuse, n = {}, 0.0, 0, 0
    for i, k, t, u, v in sorted(rows, key=lambda r: (r[2], r[0])):
        s = seen.setdefault(k, [0, 0.0, 0.0])
        if t:
            action = "v" if not s[0] else ("u" if round(s[1] / s[0], 9) >= round(s[2] / s[0], 9) else "v")
            total, reuse, n = total + (u if action == "u" else v), reuse + (s[0] > 0), n + 1
        seen[k] = [s[0] + 1, s[1] + u, s[2] + v]
    for part in (100_000, 7):  # one span of the order, and several
        got = metrics.dynamic_memory(df, "key", "i", F.col("t"), {"u": "u", "v": "v"}, "v", part).first()
        assert (got.n, got.utility, got.reuse) == (n, pytest.approx(total / n, abs=1e-6), pytest.approx(reuse / n, abs=1e-6))


def test_answer_rules(spark):
    rows = [("10", "10.005"), ("0.0005", "0"), ("Yes", "yes"), ("1,000", "1000"), (None, "1"), ("1", ""), ("nan", "1")]
    df = spark.createDataFrame(rows, "p string, g string")
    m = {r: [x[0] for x in df.select(text.answers_match(F.col("p"), F.col("g"), r)).collect()] for r in text.MATCH_RULES}
    assert m["AM-1"] == [True, True, False, True, False, False, False] and m["AM-3"][2] and not m["AM-5"][0] and m["AM-7"][0]
    cases = {"#### 12": "12", r"so \boxed{7}": "7", "The answer is 3.5": "3.5", "x = 4": "4", "none": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.extract_answer(F.col("t")).alias("a")).collect()
    assert {r.t: r.a for r in got} == cases


def test_quantities_keep_their_index(spark):
    df = spark.createDataFrame([("a, 1,200 and 3.5",), ("",), (None,)], "t string")
    got = [[(q.qid, q.value) for q in r[0]] for r in df.select(text.quantities(F.col("t"))).collect()]
    assert got == [[("q1", 1200.0), ("q2", 3.5)], [], []]


def test_permutations_are_bounded(spark):
    df = spark.createDataFrame([(1, [5.0, 6.0, 7.0], 2), (2, [1.0] * 30, 4), (3, [1.0], 2), (4, [], 1), (5, None, 1)], "id bigint, v array<double>, k int")
    got = search.permutations(df, "id", "v", "k").collect()
    assert sorted(tuple(r.order) for r in got if r.id == 1) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert [list(r.order) for r in got if r.id == 2] == [[0, 1, 2, 3]] and {r.id for r in got} == {1, 2}


def test_edits(spark):
    p = spark.createDataFrame([(1, ["A", "B"]), (2, []), (3, None)], "plan_key bigint, subs array<string>")
    lib = spark.createDataFrame([("A",), ("B",), (None,)], "sub_id string")
    got = {(r.edit, r.at, tuple(r.subs)) for r in search.edits(p, lib).collect()}
    assert ("substitute", 0, ("B", "B")) in got and ("delete", 1, ("A",)) in got and ("insert", 2, ("A", "B", "A")) in got
    assert len(got) == 2 + 6 + 2


def test_nearest_vectors(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)] + [(99, [0.0, 0.0]), (98, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = search.top_k(df.where("vec_id < 5"), df, 3).collect()
    for q in range(5):
        want = sorted(range(40), key=lambda j: (-round(math.cos(q - j), 9), j))[:3]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert search.top_k(df.where("false"), df, 3).count() == 0


def test_tree_search_is_repeatable(spark):
    from tests.test_programs import LIB

    a, b = search.tree_search([2.0, 3.0], LIB, seed=1), search.tree_search([2.0, 3.0], LIB, seed=1)
    assert a == b and a[0] and a[2] > 0.5 and search.tree_search([], LIB) == ([], None, 0.0)


def test_tree_search_tries_every_entry():
    slots = (Slot("x"),)
    lib = {f"L{i:03d}": Program(f"L{i:03d}", slots, (Step("output", "y", "x * 0"),)) for i in range(240)}
    for good in ("L000", "L117", "L239"):  # the only entry that gives something else than 0
        found = search.tree_search([2.0], lib | {good: Program(good, slots, (Step("output", "y", "x + 5"),))}, rounds=1)
        assert found == ([good], 7.0, search._reward(7.0, 1))


def test_templates(spark):
    t = spark.createDataFrame(
        [("T1", "n", "d", [("x", "int"), ("y", "int")], [(1, "add", "{x} + {y} + 3", ["x"], "r1")], 2), ("T2", "n", "d", [("r1", "int"), ("z", "int")], [(1, "mul", "{r1} * {z}", None, "r2")], 2), ("T3", None, None, None, None, None)],
        "template_id string, name string, domain string, variables array<struct<name:string,type:string>>, steps array<struct<step_id:int,operation:string,expression:string,inputs:array<string>,output_var:string>>, reuse_count bigint",
    )
    c = {(r.id_a, r.id_b): (r.steps, r.variables) for r in templates.composed(t, t, "domain").collect()}
    assert c["T1", "T2"] == (["{x} + {y} + 3", "{r1} * {z}"], ["x", "y", "z"])
    assert {r.template_id: (r.expressions, r.n_new) for r in templates.abstract(t).collect()}["T1"] == ("{x} + {y} + {c0}", 1)
    assert templates.decompose(t).count() == 2 and templates.specialize(t, F.expr("get(variables, 0).name"), F.lit("9")).where("template_id = 'T1'").first().expressions == "9 + {y} + 3"


def test_files(spark, tmp_path):
    lib = spark.createDataFrame([("L01", program("a + b", "a", "b"), 10, 1.5), ("L02", None, None, None)], f"sub_id string, program {PROGRAM.simpleString()}, support bigint, mdl_gain double")
    files.write_library(lib, str(tmp_path / "lib"))
    back = {r.sub_id: (r.support, r.program) for r in files.read_library_lines(spark, str(tmp_path / "lib")).collect()}
    assert back["L01"] == (10, lib.where("sub_id = 'L01'").first().program) and back["L02"] == (None, None)
    for name, obj in {"list": [{"a": 1}, {"a": 2}], "keyed": {"results": [{"a": 1}, {"a": 2}]}, "nested": {"x": [{"a": 1}], "y": [{"a": 2}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(obj))
        assert sorted(str(r.value) for r in files.read_predictions(spark, str(tmp_path / f"{name}.json")).select(F.to_json("value").alias("value")).collect()) == ['{"a":1}', '{"a":2}']
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_predictions(spark, str(tmp_path / "x.jsonl")).count() == 2 and files.read_jsonl(spark, str(tmp_path / "x.jsonl")).count() == 2
    m = files.manifest(spark, str(tmp_path / "x.jsonl")).first()
    assert m.file == "x.jsonl" and len(m.sha256) == 64 and m.sha256.startswith(m.head16)
    for c in ("a", "b"):
        (tmp_path / "sweep" / c).mkdir(parents=True)
        (tmp_path / "sweep" / c / "sweep_meta.json").write_text(json.dumps({"size": 1}))
    assert {r.condition for r in files.read_sweep(spark, str(tmp_path / "sweep")).collect()} == {"a", "b"}
    files.write_split(spark.createDataFrame([(1, "train"), (2, "dev")], "plan_key bigint, split string"), str(tmp_path / "split"))
    assert {tuple(r) for r in files.read_split(spark, str(tmp_path / "split")).collect()} == {(1, "train"), (2, "dev")}
    (tmp_path / "p.csv").write_text("idx,tokens\n1,5\n2,\n")
    assert [r.tokens for r in files.read_csv(spark, str(tmp_path / "p.csv")).collect()] == ["5", None]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    rows = [(t + datetime.timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in funnels.windowed_funnel(df).collect()}
    q = funnels.windowed_funnel(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("windows").collect()} == want


def test_memory_learns_from_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 5.0, 1.0), ("m", 0.0, 1.0), (None, 9.0, 9.0)], "key string, u double, v double")
    df.write.parquet(str(tmp_path / "in"))
    s = funnels.running_memory(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", ["u", "v"])
    q = s.writeStream.format("memory").queryName("memory").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("memory").collect()} == {("k", "u", 2), ("m", "v", 1)}


def test_entry_has_the_core_without_the_rest():
    e = importlib.import_module("__spark_entry__")
    assert set(core.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_growth_and_controls(spark):
    c = calls(spark, [(1, [("c0", "A", {"x": REF, "y": REF}, None)], None), (2, [("c0", "a ", {"x": ("quantity", 5.0, None, None, None, None, None, None)}, None)], None)])
    assert {(r.sub, r.slot): r.varies for r in evolve.varying_slots(c).collect()} == {("A", "x"): True, ("A", "y"): False}
    rows = [(1, [], [("compute", "t", "a + b", ["a", "b"], "float"), ("compute", "u", "t * c", ["t", "c"], "float"), ("output", "u", "u", ["u"], "float")], None), (2, None, None, None)]
    p = spark.createDataFrame(rows, f"row_id bigint, slots array<struct<name:string,dtype:string,description:string>>, steps array<{STEP.simpleString()}>, source string")
    prims = spark.createDataFrame([("compute", "a0 + a1", 2, "P1"), ("compute", "a0 * a1", 2, "P2")], "op string, canonical string, arity bigint, prim string")
    assert [tuple(r) for r in evolve.program_plans(p, prims).collect()] == [(1, "P1(a, b)>P2(@0, c)")]
    assert evolve.program_plans(p, prims.where("prim = 'P1'")).count() == 0
    lib = spark.createDataFrame([("L1", program("a + b", "a", "b"), 5, 1.0)], f"sub_id string, program {PROGRAM.simpleString()}, support bigint, mdl_gain double")
    assert [tuple(r) for r in evolve.rebuilt_choice(p, lib).collect()] == [(1, "L1", 1)]
    assert evolve.rebuilt_choice(p, lib.where("false")).first().sub_id is None


def test_programs_of_text_count(spark, tmp_path):
    steps = [("compute", "t", "a + b", ["a", "b"], "float"), ("output", "t", "t", ["t"], "float")]
    text = json.dumps({"slots": [{"name": "a", "dtype": "float"}, {"name": "b", "dtype": "float"}], "steps": [dict(zip(("op", "target", "expr", "inputs", "target_dtype"), s)) for s in steps]})
    slots = [("a", "float", None), ("b", "float", None)]
    rows = [(1, slots, steps, None, "x"), (2, None, None, text, "x"), (3, None, None, text, "y"), (4, None, None, "{broken", "y"), (5, None, None, None, "y")]
    schema = f"row_id bigint, slots array<struct<name:string,dtype:string,description:string>>, steps array<{STEP.simpleString()}>, output string, source string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "programs.parquet"))
    lib = spark.createDataFrame([("L1", program("a + b", "a", "b"), 5, 1.0)], f"sub_id string, program {PROGRAM.simpleString()}, support bigint, mdl_gain double")
    lib.write.parquet(str(tmp_path / "sub_library.parquet"))
    run = lambda name: core.QUERIES[name](spark, str(tmp_path))
    assert [(r.support, r.first_id) for r in run("library_add").collect()] == [(2, 1)]
    assert run("step_primitives").first().support == 3
    for name in ("fingerprints", "greedy_cover", "rebuilt_choice"):
        assert sorted(r.row_id for r in run(name).collect()) == [1, 2, 3]
    assert run("library_mining").first().support == 3 and run("window_controls").count() == 1


def test_a_constrained_split_is_the_best_of_all_trials(spark):
    rng = random.Random(3)
    ref = lambda: {k: REF for k in rng.sample("xyz", rng.randint(1, 2))}
    c = calls(spark, [(i, [(f"c{j}", rng.choice("ABCDE"), ref(), None) for j in range(rng.randint(1, 4))], None) for i in range(60)])
    scores = {r.trial: (r.tvd, r.divergence) for r in features.trial_scores(c, features.TRIALS).collect()}
    assert features.TRIALS == 500 and sorted(scores) == list(range(500))
    splits = features.assignments(c.select("plan_key").distinct(), 500)
    for t in (0, 63, 64, 499):  # against the definition, on both sides of a number's end
        keys = splits.where(F.col("trial") == t)
        train, test = F.col("split") == "train", F.col("split") == "test"
        assert scores[t][0] == features.tvd(features.atoms(c).join(keys, "plan_key").where(train | test), train).first().tvd
        assert scores[t][1] == features.divergence(features.compounds(c).join(keys, "plan_key"), train, test).first().divergence
    tier = lambda t: 2 if scores[t][0] <= 0.2 and scores[t][1] >= 0.1 else 1 if scores[t][0] <= 0.4 else 0
    best = max(scores, key=lambda t: (tier(t), scores[t][1] if tier(t) else 0, -t))
    assert best >= 20
    got = {(r.plan_key, r.split) for r in features.constrained_split(c, max_tvd=0.2).collect()}
    assert got == {(r.plan_key, r.split) for r in splits.where(F.col("trial") == best).collect()}


def test_neighbours_of_the_whole_library(spark):
    lib = spark.createDataFrame([(f"L{i:03d}", program("a + b", "a", "b")) for i in range(12)], f"sub_id string, program {PROGRAM.simpleString()}")
    far = {"a": REF, "b": ("call_output", None, "c0", None, None, None, None, None), "z": REF}
    rows = [(1, [("c0", " l009", far, None), ("c1", "ZZ", {"b": REF}, None)]), (2, [("c0", None, None, None)]), (3, []), (4, None), (5, [("c0", "L011", far, None)] * 6)]
    p = spark.createDataFrame(rows, f"plan_key bigint, calls array<{CALL.simpleString()}>")
    got = {r.edit: r.n for r in search.edit_counts(p, lib).collect()}
    subs = p.select("plan_key", F.transform("calls", lambda c: F.upper(F.trim(c["sub_id"]))).alias("subs"))
    want = {r.edit: r.n for r in search.edits(subs, lib).groupBy("edit").agg(F.count("*").alias("n")).collect()}
    # plan 1: both slots of the known call to two of a, b and z; plan 5: six calls, a to z and b to a or z
    assert got == want | {"rebind": 4 + 18}
    assert {(r["at"], r.slot, r.name) for r in search.rebinds(p.where("plan_key = 1"), lib).collect()} == {(0, "a", "b"), (0, "a", "z"), (0, "b", "a"), (0, "b", "z")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_two_templates_are_composed(spark):
    n = spark.read.parquet(f"{DATA}/templates.parquet").count()
    pairs = core.QUERIES["template_compose"](spark, DATA)
    assert pairs.agg(F.sum("n_composed")).first()[0] == n * (n - 1)
