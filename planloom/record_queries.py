"""Queries on records, files and small scalars by name, with their SQL; see ``queries``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.functions.types import coerce_sql
from planloom.operators import records
from planloom.plans.programs import Program, Slot, Step, with_program
from planloom.plans.schemas import PLAN
from planloom.queries import _CALLS, _ONE_ITEM, _PLANS, _calls, _items, _plans, query
from planloom.session import scratch
from planloom.sources import files
from planloom.sources.tables import table


# --- files ---------------------------------------------------------------------------------------------------------


@query("file_library", "SELECT sub_id, support, mdl_gain, CAST(len(program.slots) AS BIGINT) AS n_slots, array_to_string(list_transform(program.steps, lambda s: s.op || ':' || s.expr), ';') AS steps FROM sub_library WHERE sub_id IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    files.write_library(table(spark, d, "sub_library"), path)
    lib = files.read_library_lines(spark, path)
    return lib.select("sub_id", "support", "mdl_gain", F.size("program.slots").cast("bigint").alias("n_slots"), F.array_join(F.transform("program.steps", lambda s: F.concat(s["op"], F.lit(":"), s["expr"])), ";").alias("steps"))


@query("file_templates", "SELECT template_id, name, domain, coalesce(reuse_count, 0) AS reuse_count, coalesce(array_to_string(list_transform(variables, lambda v: v.name || ':' || v.type), ','), '') AS variables, array_to_string(list_transform(steps, lambda s: s.step_id || s.operation || s.expression || s.output_var), ';') AS steps FROM templates WHERE template_id IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    files.write_templates(table(spark, d, "templates"), path)
    t = files.read_templates(spark, path)
    return t.select("template_id", "name", "domain", "reuse_count", F.coalesce(F.array_join(F.transform("variables", lambda v: F.concat(v["name"], F.lit(":"), v["type"])), ","), F.lit("")).alias("variables"), F.array_join(F.transform("steps", lambda s: F.concat(s["step_id"].cast("string"), s["operation"], s["expression"], s["output_var"])), ";").alias("steps"))


@query("file_jsonl", "SELECT DISTINCT msg_id, turn, role, content FROM chat_messages")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    files.write_jsonl(table(spark, d, "chat_messages").select("msg_id", "turn", "role", "content"), path)
    return files.read_jsonl(spark, path, "msg_id bigint, turn bigint, role string, content string").distinct()


@query("file_csv", "SELECT CAST(vec.doc_id AS VARCHAR) AS doc_id, form, annotator FROM doc_labels vec")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    table(spark, d, "doc_labels").write.csv(path, header=True)
    return files.read_csv(spark, path)


@query("file_predictions", "SELECT layout, item_id, answer FROM (SELECT item_id, answer FROM heldout_items), (SELECT unnest(['list', 'keyed', 'nested', 'lines']) AS layout)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Records in each of the layouts of a predictions file, written and read."""
    h = table(spark, d, "heldout_items").select("item_id", "answer")
    one = h.agg(F.to_json(F.collect_list(F.struct("item_id", "answer"))).alias("j"))  # a file of this kind is one value
    layouts = {"list": F.col("j"), "keyed": F.concat(F.lit('{"results": '), "j", F.lit("}")), "nested": F.concat(F.lit('{"some": '), "j", F.lit(', "none": []}'))}
    out = []
    for name, value in layouts.items():
        path = scratch(spark)
        one.select(value.alias("value")).coalesce(1).write.text(path)
        out.append((name, path))
    path = scratch(spark)
    h.coalesce(1).write.json(path)
    out.append(("lines", path))
    parts = {n: files.read_predictions(spark, f"{p}/part-*").select(F.try_variant_get("value", "$.item_id", "bigint").alias("item_id"), F.try_variant_get("value", "$.answer", "string").alias("answer")) for n, p in out}
    return records.named_union(parts, "layout")


@query("file_sweep", "SELECT 'k' || n_nationkey AS condition, n_name AS name, n_nationkey AS size FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    """One small file of results per directory."""
    path = scratch(spark)
    n = table(spark, d, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("condition"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("size"))
    for r in n.collect():  # a directory for each condition of an experiment
        line = json.dumps({"name": r["name"], "size": r["size"]})
        out = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r.condition}/sweep_meta.json")
        stream = out.getFileSystem(spark._jsc.hadoopConfiguration()).create(out)
        stream.write(line.encode())
        stream.close()
    return files.read_sweep(spark, path).select("condition", "name", "size")


@query("file_split", "SELECT DISTINCT item_id AS plan_key, CASE WHEN item_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM eval_results")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    split = table(spark, d, "eval_results").select(F.col("item_id").alias("plan_key"), F.when(F.col("item_id") % 5 == 0, "test").otherwise("train").alias("split")).distinct()
    files.write_split(split, path)
    return files.read_split(spark, path)


@query(
    "file_manifest",
    "WITH t AS (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS x FROM region) SELECT 'part' AS file, CAST(strlen(x) AS BIGINT) AS n_bytes, sha256(x) AS sha256, sha256(x)[1:16] AS head16 FROM t",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    table(spark, d, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    return files.manifest(spark, f"{path}/part-*").withColumn("file", F.lit("part"))


@query("file_resumed", "SELECT DISTINCT item_id, length(problem) AS n_chars FROM eval_results WHERE problem IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An extraction that is cut off after three parts and goes on where it was."""
    path = scratch(spark)
    items = table(spark, d, "eval_results").where("problem is not null").select("item_id", "problem").distinct()
    work = lambda df: df.select("item_id", F.length("problem").cast("bigint").alias("n_chars")).distinct()
    files.extracted(items, "item_id", path, work, stop_after=3)
    return files.extracted(items, "item_id", path, work)


# --- sources and positions -----------------------------------------------------------------------------------------


@query("head_rows", "SELECT item_id, problem FROM heldout_items ORDER BY item_id LIMIT 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.first_rows(table(spark, d, "heldout_items"), "item_id", 40).select("item_id", "problem")


@query("named_union", f"SELECT 'eval' AS dataset, item_id, problem, answer FROM ({_ONE_ITEM}) UNION ALL SELECT 'heldout', item_id, problem, answer FROM heldout_items")
def _(spark: SparkSession, d: str) -> DataFrame:
    cols = ("item_id", "problem", "answer")
    return records.named_union({"eval": _items(spark, d).select(*cols), "heldout": table(spark, d, "heldout_items").select(*cols)}).select("dataset", *cols)


@query(
    "product_programs",
    r"""
    WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\d[\d,]*\.?\d*'), lambda m: try_cast(replace(m, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS f FROM documents),
    p AS (SELECT doc_id, CASE WHEN len(f) >= 2 THEN f[1] ELSE (doc_id * 7 + 3) % 100 + 1 END AS a, CASE WHEN len(f) >= 2 THEN f[2] ELSE (doc_id * 11 + 5) % 50 + 1 END AS b FROM n)
    SELECT doc_id, a, b, a * b AS result FROM p
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.products(table(spark, d, "documents"), "doc_id", "text")


def _store_sql(mode: str) -> str:
    problem = "'Problem: A store has ' || a || ' items at $' || b || ' each. What is the total cost?'"
    answer = """'{"plan": [{"sub_id": "L00", "bindings": {"quantity": ' || a || ', "price": ' || b || '}}]}'""" if mode == "compose" else (
        """'{"program_id": "flat_' || i || '", "slots": [{"name": "quantity", "dtype": "int"}, {"name": "price", "dtype": "float"}], "steps": [{"op": "compute", "target": "total", "expr": "quantity * price"}, {"op": "output", "target": "__output__", "expr": "total"}]}'"""
    )
    said = lambda role, x: f"'<|im_start|>{role}' || chr(10) || {x} || '<|im_end|>'"
    return (
        f"WITH n AS (SELECT i, (7 * i + 3) % 100 + 1 AS a, (11 * i + 5) % 50 + 1 AS b FROM range(0, 2000) r(i)) SELECT i, {said('system', repr('Answer in JSON.'))} || chr(10) || {said('user', problem)} || chr(10) || {said('assistant', answer)} AS text FROM n"
    )


for _mode in ("flat", "compose"):
    query(f"store_problems_{_mode}", _store_sql(_mode))(lambda spark, d, mode=_mode: records.store_problems(spark, 2000, mode, "Answer in JSON."))


@query("rows_at_positions", "SELECT x.k AS item_id, h.answer FROM (SELECT 1000 + 7 * ((5 * i) % 400) AS k FROM range(0, 500) r(i)) x JOIN heldout_items h ON h.item_id = x.k")
def _(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(500).select((1000 + 7 * ((5 * F.col("id")) % 400)).alias("item_id"))
    return records.at_positions(table(spark, d, "heldout_items"), "item_id", wanted, "item_id").select("item_id", "answer")


@query(
    "split_by_index_or_id",
    "SELECT template_id, name FROM templates WHERE CAST(template_id[2:] AS BIGINT) IN (SELECT turn * 3 FROM chat_messages) OR template_id IN (SELECT template_id FROM eval_results WHERE lower(trim(split)) = 'dev')",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "templates").withColumn("idx", F.substring("template_id", 2, 18).cast("bigint"))
    members = records.named_union({"a": table(spark, d, "chat_messages").select((F.col("turn") * 3).alias("index")), "b": table(spark, d, "eval_results").where("lower(trim(split)) = 'dev'").select("template_id")})
    return files.in_split(t, "idx", members, "index", "template_id").select("template_id", "name")


@query(
    "matched_problems",
    f"WITH i AS ({_ONE_ITEM}), t AS (SELECT DISTINCT problem FROM eval_results WHERE lower(trim(split)) IN ('dev', 'test')) SELECT item_id, source FROM i WHERE problem IN (SELECT problem FROM t) AND item_id IN (SELECT item_id FROM eval_results WHERE lower(trim(split)) = 'train')",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Training items whose problem is also one of another split, by its text."""
    e = table(spark, d, "eval_results")
    others = e.where("lower(trim(split)) in ('dev', 'test') and problem is not null").select("problem").distinct()
    train = e.where("lower(trim(split)) = 'train'").select("item_id").distinct()
    return _items(spark, d).join(others, "problem", "left_semi").join(train, "item_id", "left_semi").select("item_id", "source")


@query(
    "rows_by_key",
    f"WITH i AS ({_ONE_ITEM}), r AS (SELECT template_id, item_id, row_number() OVER (PARTITION BY template_id ORDER BY md5('42|' || template_id || '|' || item_id), item_id) AS rank FROM i WHERE template_id IS NOT NULL) SELECT template_id, item_id, rank FROM r WHERE rank <= 2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.rows_by_key(_items(spark, d), "template_id", "item_id", 2).select("template_id", "item_id", "rank")


@query(
    "plans_of_entries",
    f"WITH {_CALLS}, p AS (SELECT DISTINCT sub, plan_key FROM calls WHERE sub IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY md5('42|' || sub || '|' || plan_key), plan_key) AS rank FROM p) SELECT sub, plan_key, rank FROM r WHERE rank <= 3",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Three plans that call a library entry, by hash, for each entry."""
    return records.rows_by_key(_calls(spark, d).select("sub", "plan_key").distinct(), "sub", "plan_key", 3).select("sub", "plan_key", "rank")


@query(
    "shortest_trace",
    f"WITH i AS ({_ONE_ITEM}) SELECT template_id, item_id, n_chars FROM (SELECT template_id, item_id, length(problem) AS n_chars, row_number() OVER (PARTITION BY template_id ORDER BY length(problem), item_id) AS r FROM i WHERE correct AND template_id IS NOT NULL AND problem IS NOT NULL) WHERE r = 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.shortest(_items(spark, d).where("correct"), "template_id", "problem", "item_id")


# --- scalars -------------------------------------------------------------------------------------------------------


@query(
    "value_matches",
    """
    WITH a AS (SELECT DISTINCT item_id, answer FROM eval_results WHERE answer IS NOT NULL)
    SELECT item_id, answer, try_cast(answer AS DOUBLE) IS NOT NULL AS is_number, true AS is_text, coalesce(CAST(trunc(try_cast(answer AS DOUBLE)) AS BIGINT), 0) AS as_int, coalesce(try_cast(answer AS DOUBLE), 0) AS as_float FROM a
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "eval_results").where("answer is not null").select("item_id", "answer").distinct()
    v = F.col("answer")
    return a.select("item_id", "answer", records.matches_type(v, F.lit("number")).alias("is_number"), records.matches_type(v, F.lit("string")).alias("is_text"), records.to_int(v).alias("as_int"), records.to_float(v).alias("as_float"))


@query("type_checks", "SELECT item_id, bool_or(try_cast(answer AS DOUBLE) IS NOT NULL) AS any_float, bool_and(try_cast(answer AS DOUBLE) IS NOT NULL) AS all_int, true AS all_string FROM eval_results WHERE answer IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Which answers can be of a type: those that are of it after coercion."""
    t = table(spark, d, "eval_results").where("answer is not null")
    can = lambda kind: F.expr(f"{coerce_sql('answer', kind)} IS NOT NULL")
    return t.groupBy("item_id").agg(F.bool_or(can("float")).alias("any_float"), F.bool_and(can("int")).alias("all_int"), F.bool_and(can("string")).alias("all_string"))


@query(
    "program_failures",
    """
    SELECT l_orderkey, l_partkey, l_linenumber, CAST(CASE WHEN l_discount = 0 THEN 1 WHEN l_tax < l_discount THEN 2 ELSE -1 END AS BIGINT) AS failed_step, l_discount <> 0 AND l_tax >= l_discount AS ok,
        CAST(-2 AS BIGINT) AS unbound_step, false AS too_long_ok, true AS longest_ok FROM lineitem
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Where a program fails: at a step, for a slot without a value, or because it is too long."""
    p = Program("f", (Slot("a"), Slot("b")), (Step("compute", "s", "a + b"), Step("compute", "q", "a / b"), Step("output", "r", "sqrt(a - b)")))
    unbound = Program("u", (Slot("a"), Slot("z")), (Step("output", "s", "a"),))
    t = with_program(table(spark, d, "lineitem"), p, {"a": "l_tax", "b": "l_discount"})
    t = with_program(t, unbound, {"a": "l_tax"}, "u_")
    for name, n in (("long_", 101), ("most_", 100)):
        t = with_program(t, Program("n", (), tuple(Step("output", "x", "1") for _ in range(n))), {}, name)
    return t.select("l_orderkey", "l_partkey", "l_linenumber", F.col("failed_step").cast("bigint").alias("failed_step"), "ok", F.col("u_failed_step").cast("bigint").alias("unbound_step"), F.col("long_ok").alias("too_long_ok"), F.col("most_ok").alias("longest_ok"))


@query("hidden_names", "SELECT p_partkey, p_size + p_retailprice AS sum_of_names, p_size * 2.0 AS min_as_value FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Slots that are called as a constant or a function: their values count."""
    p = Program("h", (Slot("e"), Slot("pi"), Slot("min")), (Step("compute", "sum_of_names", "e + pi"), Step("output", "min_as_value", "min * 2")))
    return with_program(table(spark, d, "part"), p, {"e": "p_size", "pi": "p_retailprice", "min": "p_size"}).select("p_partkey", "sum_of_names", "min_as_value")


@query(
    "indexed_bindings",
    r"""
    WITH n AS (SELECT item_id, regexp_extract_all(problem, '[0-9,]+\.?[0-9]*') AS f FROM heldout_items WHERE problem IS NOT NULL),
    v AS (SELECT item_id, list_filter(list_transform(f, lambda m, i: {'q': 'q' || (i - 1), 'v': try_cast(replace(m, ',', '') AS DOUBLE)}), lambda x: x.v IS NOT NULL) AS v FROM n), e AS (SELECT item_id, v, unnest(range(1, len(v) + 1)) AS i FROM v)
    SELECT item_id, v[i].q AS qid, 'x' || (i - 1) AS name, v[i].v AS value FROM e
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "heldout_items").where("problem is not null")
    named = h.select("item_id", F.explode(text.indexed_bindings(F.col("problem"))).alias("name", "value"))
    keyed = h.select("item_id", F.posexplode(F.map_keys(text.quantity_map(F.col("problem")))).alias("i", "qid"))
    return named.join(keyed.select("item_id", "qid", F.concat(F.lit("x"), F.col("i").cast("string")).alias("name")), ["item_id", "name"]).select("item_id", "qid", "name", "value")


@query(
    "normal_records",
    f"WITH i AS ({_ONE_ITEM}) SELECT item_id, coalesce(nullif(problem, ''), nullif(template_id, '')) AS question, coalesce(nullif(answer, ''), nullif(CAST(CAST(exec_result AS BIGINT) AS VARCHAR), '')) AS answer FROM i "
    "WHERE coalesce(nullif(problem, ''), nullif(template_id, '')) IS NOT NULL AND coalesce(nullif(answer, ''), CAST(CAST(exec_result AS BIGINT) AS VARCHAR)) IS NOT NULL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Records of several layouts with one question and one answer; incomplete ones are left out."""
    i = _items(spark, d).withColumn("r", F.bround("exec_result", 0).cast("bigint").cast("string"))
    return i.select("item_id", files.first_present(F.col("problem"), F.col("template_id")).alias("question"), files.first_present(F.col("answer"), F.col("r")).alias("answer")).where("question is not null and answer is not null")


@query(
    "valid_programs",
    """
    WITH t AS (SELECT row_id, output, slots IS NULL AND steps IS NULL AS only_text, try_cast(output AS JSON) AS j FROM programs),
    s AS (SELECT row_id, json_transform(j, '{"slots": [{"dtype": "VARCHAR"}], "steps": [{"op": "VARCHAR", "target_dtype": "VARCHAR"}]}') AS p FROM t WHERE only_text),
    ok AS (SELECT ['int', 'float', 'string', 'bool', 'list[int]', 'list[float]'] AS d, ['assign', 'compute', 'compare', 'aggregate', 'condition', 'output'] AS o)
    SELECT row_id, coalesce(len(p.steps) > 0 AND len(list_filter(p.steps, lambda x: x.op IS NULL OR NOT list_contains(o, lower(trim(x.op))) OR (x.target_dtype IS NOT NULL AND NOT list_contains(d, lower(trim(x.target_dtype)))))) = 0
        AND len(list_filter(coalesce(p.slots, []), lambda x: x.dtype IS NOT NULL AND NOT list_contains(d, lower(trim(x.dtype))))) = 0, false) AS valid FROM s, ok
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold a program with known operations and types."""
    from planloom.plans.programs import parsed_programs

    t = table(spark, d, "programs").where("slots is null and steps is null")
    return parsed_programs(t).select("row_id", records.valid_program(F.col("slots"), F.col("steps")).alias("valid"))


# --- texts and plans -----------------------------------------------------------------------------------------------


@query(
    "template_prompts",
    "SELECT template_id, 'Template: ' || coalesce(name, '') || chr(10) || 'Variables: ' || coalesce(array_to_string(list_transform(variables, lambda v: v.name), ', '), '') || chr(10) || 'Steps:' || coalesce(array_to_string(list_transform(steps, lambda s: chr(10) || '  ' || s.step_id || '. [' || s.operation || '] ' || s.expression), ''), '') AS prompt FROM templates",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return records.template_prompts(table(spark, d, "templates"))


@query(
    "plans_as_json",
    f"WITH {_CALLS} SELECT plan_key, count(*) AS n_calls, CAST(coalesce(sum(len(keys)), 0) AS BIGINT) AS n_bindings, round(coalesce(sum(list_sum(list_transform(map_values(refs), lambda r: coalesce(r.value, 0)))), 0), 4) AS total FROM calls GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Plans written as JSON texts and read back."""
    p = _plans(spark, d).where(F.size("calls") > 0).select("plan_key", records.plan_json(F.col("calls"), F.col("final")).alias("j"))
    back = p.select("plan_key", F.from_json("j", PLAN).alias("p")).select("plan_key", F.explode("p.calls").alias("c"))
    values = F.aggregate(F.map_values("c.bindings"), F.lit(0.0), lambda a, r: a + F.coalesce(r["value"], F.lit(0.0)))
    return back.groupBy("plan_key").agg(F.count("*").alias("n_calls"), F.sum(F.greatest(F.coalesce(F.size("c.bindings"), F.lit(0)), F.lit(0))).alias("n_bindings"), F.round(F.coalesce(F.sum(values), F.lit(0.0)), 4).alias("total"))


@query(
    "plans_without_edges",
    f"""
    WITH {_CALLS}, r AS (SELECT plan_key, pos, unnest(map_entries(refs)) AS e FROM calls),
    f AS (SELECT plan_key, min_by(e.value.value, {{'p': pos, 'k': e.key}}) AS first FROM r WHERE e.value.source = 'quantity' AND e.value.value IS NOT NULL GROUP BY 1)
    SELECT r.plan_key, pos, e.key AS slot, CASE WHEN e.value.source = 'call_output' THEN 'quantity' ELSE e.value.source END AS source, CASE WHEN e.value.source = 'call_output' THEN coalesce(first, 0) ELSE e.value.value END AS value FROM r LEFT JOIN f USING (plan_key)
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = records.without_edges(_plans(spark, d))
    c = p.select("plan_key", F.posexplode("calls").alias("pos", "c")).select("plan_key", F.col("pos").cast("bigint").alias("pos"), F.explode("c.bindings").alias("slot", "r"))
    return c.select("plan_key", "pos", "slot", "r.source", "r.value")


@query(
    "record_variants",
    f"""
    WITH {_PLANS}, k AS (SELECT plan_key AS key, calls FROM plans WHERE len(calls) > 0), i AS ({_ONE_ITEM})
    SELECT variant, count(*) AS n FROM (SELECT 'plan' AS variant FROM k UNION ALL SELECT 'no_edges' FROM k UNION ALL SELECT 'flat' FROM i WHERE problem IS NOT NULL AND program IS NOT NULL) GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """How many training texts each variant of the data has; all of them are rendered."""
    plans = _plans(spark, d).select(F.col("plan_key").alias("key"), F.concat(F.lit("Plan "), F.col("plan_key").cast("string")).alias("problem"), "calls", "final")
    flat = _items(spark, d).select(F.col("item_id").alias("key"), "problem", "program")
    parts = {"plan": records.record_texts(plans, "plan"), "no_edges": records.record_texts(plans, "no_edges"), "flat": records.record_texts(flat, "flat")}
    return records.named_union(parts, "variant").where(F.length("text") > 0).groupBy("variant").agg(F.count("*").alias("n"))


@query(
    "missing_slots",
    f"""
    WITH {_CALLS}, l AS (SELECT upper(trim(sub_id)) AS sub, list_transform(program.slots, lambda s: s.name) AS need FROM sub_library)
    SELECT plan_key, pos, array_to_string(list_filter(need, lambda n: NOT list_contains(keys, n)), ',') AS missing FROM calls JOIN l USING (sub) WHERE len(list_filter(need, lambda n: NOT list_contains(keys, n))) > 0
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The slots that a call's program needs and the call doesn't bind."""
    lib = table(spark, d, "sub_library").select(F.upper(F.trim("sub_id")).alias("sub"), F.transform("program.slots", lambda s: s["name"]).alias("need"))
    m = _calls(spark, d).join(lib, "sub").select("plan_key", "pos", F.array_except("need", "keys").alias("m")).where(F.size("m") > 0)
    return m.select("plan_key", "pos", F.array_join("m", ",").alias("missing"))


@query(
    "plans_with_pattern",
    f"""
    WITH {_CALLS}, s AS (SELECT plan_key, list(sub ORDER BY pos) AS subs FROM calls WHERE sub IS NOT NULL GROUP BY 1), m AS (SELECT plan_key, subs, unnest(range(1, len(subs) + 1)) AS i FROM s), w AS (SELECT DISTINCT plan_key, array_to_string(subs[i:i + n - 1], '>') AS gram FROM m, (SELECT unnest(range(2, 7)) AS n) WHERE i + n - 1 <= len(subs)),
    p AS (SELECT pattern_id, array_to_string(list_transform(ids, lambda x: upper(trim(x))), '>') AS gram FROM (SELECT pattern_id, any_value(sub_ids) AS ids FROM composition_patterns GROUP BY 1) WHERE len(ids) BETWEEN 2 AND 6)
    SELECT pattern_id, count(*) AS n_plans, min(plan_key) AS example FROM p JOIN w USING (gram) GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Plans that call a pattern's programs one right after the other: an equi-join of all runs of a plan with the patterns."""
    subs = F.filter(F.transform("calls", lambda c: F.upper(F.trim(c["sub_id"]))), lambda s: s.isNotNull())
    runs = "flatten(transform(sequence(1, greatest(size(subs), 1)), i -> transform(filter(sequence(2, 6), n -> i + n - 1 <= size(subs)), n -> array_join(slice(subs, i, n), '>'))))"
    w = _plans(spark, d).select("plan_key", subs.alias("subs")).select("plan_key", F.explode(F.array_distinct(F.expr(runs))).alias("gram"))
    p = table(spark, d, "composition_patterns").where("pattern_id is not null and size(sub_ids) between 2 and 6").groupBy("pattern_id").agg(F.max("sub_ids").alias("ids"))
    p = p.select("pattern_id", F.array_join(F.transform("ids", lambda x: F.upper(F.trim(x))), ">").alias("gram"))
    return p.join(w, "gram").groupBy("pattern_id").agg(F.count("*").alias("n_plans"), F.min("plan_key").alias("example"))


@query(
    "domain_pairs",
    "WITH d AS (SELECT domain, count(*) AS n FROM templates WHERE domain IS NOT NULL GROUP BY 1) SELECT a.domain AS domain_a, b.domain AS domain_b, a.n * b.n AS n_pairs FROM d a JOIN d b ON a.domain < b.domain",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every two domains, once, with how many pairs of templates they have."""
    n = table(spark, d, "templates").where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))
    a, b = (n.select(F.col("domain").alias(f"domain_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, F.col("domain_a") < F.col("domain_b")).select("domain_a", "domain_b", (F.col("n_a") * F.col("n_b")).alias("n_pairs"))
