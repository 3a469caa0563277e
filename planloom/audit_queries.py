"""Queries on audits, growth and search by name, with their SQL; see ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.operators import audits, evolve, features, growth, library, metrics, search
from planloom.plans import execute
from planloom.plans.programs import sql_function
from planloom.queries import (
    _ATOMS, _CALLS, _COMPOUNDS, _FP, _ONE_ITEM, _PLANS, _RUN, _TYPED, _UTIL, _VARIANTS, CHARGE, _again, _calls, _items, _library, _plans, _programs, memory_rows, query,
)
from planloom.session import cut, scratch
from planloom.sources.tables import stream, table
from planloom.streaming import funnels

_PLANS_BY = _PLANS.replace("bool_or(success) AS success", "bool_or(success) AS success, min(source) AS source, min(template_id) AS template_id")


def _plans_by(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "dataflow_plans").where("plan_key is not null").groupBy("plan_key")
    return p.agg(F.first("calls").alias("calls"), F.first("final").alias("final"), F.max("success").alias("success"), F.min("source").alias("source"), F.min("template_id").alias("template_id"))


# --- plans ---------------------------------------------------------------------------------------------------------

_WITH_SUCCESS = "p2 AS (SELECT d.*, coalesce(p.success, false) AS right_, p.source AS source, len(list_filter(d.calls, lambda c: len(list_filter(map_values(c.bindings), lambda r: r.source = 'call_output')) > 0)) > 0 AS edge FROM done d JOIN plans2 p ON p.plan_key = d.id)"
_AUDITED = f"{_RUN}, {_PLANS_BY.replace('plans AS', 'plans2 AS', 1)}, {_WITH_SUCCESS}"

_VARIED = """base AS (SELECT id, calls, final, result FROM done WHERE ok), each AS (SELECT id, calls, final, result, generate_subscripts(calls, 1) AS pos FROM base),
    refs AS (SELECT *, unnest(map_entries(calls[pos].bindings)) AS b FROM each), inline AS (SELECT * FROM refs WHERE b.value.source <> 'call_output' AND b.value.value IS NOT NULL),
    tried AS (SELECT *, unnest([1.1, 0.9]) AS f FROM inline WHERE b.value.value <> 0),
    variants AS (SELECT {'id': id, 'pos': pos, 'slot': b.key, 'f': f} AS id, final, result AS base_result, list_transform(calls, lambda c, i: {'call_id': c.call_id, 'sub_id': c.sub_id, 'bindings': CASE WHEN c.bindings IS NOT NULL THEN map_from_entries(list_transform(map_entries(c.bindings),
        lambda e: {'k': e.key, 'v': {'source': e.value.source, 'value': CASE WHEN i = pos AND e.key = b.key THEN e.value.value * CAST(f AS DOUBLE) ELSE e.value.value END, 'call_id': e.value.call_id, 'qid': e.value.qid}})) END}) AS calls FROM tried)"""


@query(
    "plan_sensitivity",
    f"""
    {_RUN}, {_VARIED}, {_again("again", "variants")},
    moved AS (SELECT v.id.id AS id, v.id.pos AS pos, v.id.slot AS slot, bool_or(d.ok AND abs(d.result - v.base_result) > 1e-6) AS m FROM variants v JOIN again_done d USING (id) GROUP BY 1, 2, 3),
    a AS (SELECT id, count(*) FILTER (WHERE m) AS n FROM moved GROUP BY 1), t AS (SELECT id, count(*) AS n FROM inline GROUP BY 1)
    SELECT t.id AS plan_key, t.n AS n_bindings, coalesce(a.n, 0) AS n_active FROM t LEFT JOIN a USING (id)
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return audits.sensitivity(_plans(spark, d), _library(spark, d))


@query(
    "plan_active_each",
    f"""
    {_RUN}, {_VARIANTS}, {_again("again", "variants")},
    a AS (SELECT v.id.id AS id, NOT d.ok OR abs(d.result - v.base_result) > 1e-6 AS active FROM variants v JOIN again_done d USING (id))
    SELECT id AS plan_key, count(*) AS n_tested, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE NOT active) AS n_dead FROM a GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Per plan the bindings that were changed, and those that matter."""
    a = execute.active_bindings(_plans(spark, d), _library(spark, d))
    return a.groupBy("plan_key").agg(F.count("*").alias("n_tested"), F.count_if("active").alias("n_active"), F.count_if(~F.col("active")).alias("n_dead"))


@query(
    "mechanism_rates",
    f"""
    {_AUDITED}, {_again("free", "src", stop=False)},
    h AS (SELECT id, list_filter(list_transform(coalesce(calls, []), lambda c, i: {{'hint': c.value_hint.value, 'value': outs[i].value}}), lambda h: h.hint IS NOT NULL) AS h FROM free_done),
    c AS (SELECT id, len(h) AS n_hints, len(list_filter(h, lambda x: x.value IS NOT NULL)) AS compared, len(list_filter(h, lambda x: x.value IS NOT NULL AND abs(x.hint - x.value) < greatest(0.01 * abs(x.value), 1e-3))) AS good FROM h),
    j AS (SELECT p2.*, n_hints, compared > 0 AS checked, compared > 0 AND compared = good AS agreement FROM p2 JOIN c USING (id))
    SELECT coalesce(source, '') AS source, count(*) AS n, round(count(*) FILTER (WHERE n_calls > 0) / count(*), 4) AS parse_rate, round(count(*) FILTER (WHERE n_hints > 0) / count(*), 4) AS hint_rate, round(count(*) FILTER (WHERE edge) / count(*), 4) AS edge_rate,
        round(count(*) FILTER (WHERE ok) / count(*), 4) AS exec_rate, round(count(*) FILTER (WHERE checked AND agreement) / nullif(count(*) FILTER (WHERE checked), 0), 4) AS agreement_rate, round(count(*) FILTER (WHERE checked AND agreement) / nullif(count(*) FILTER (WHERE checked), 0), 4) AS consistency_rate,
        round(count(*) FILTER (WHERE ok AND right_) / count(*), 4) AS symbolic_accuracy, round(count(*) FILTER (WHERE agreement AND right_) / count(*), 4) AS hint_accuracy, round(count(*) FILTER (WHERE ok AND agreement AND right_) / count(*), 4) AS gate_accuracy, round(count(*) FILTER (WHERE right_) / count(*), 4) AS accuracy
    FROM j GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return audits.mechanism_rates(_plans_by(spark, d), _library(spark, d))


@query(
    "faithful_audit",
    f"""
    {_AUDITED}, h AS (SELECT string_agg(n_calls || ':' || n, ',' ORDER BY n_calls) AS call_counts FROM (SELECT n_calls, count(*) AS n FROM p2 WHERE n_calls > 0 GROUP BY 1))
    SELECT count(*) AS total, count(*) FILTER (WHERE n_calls > 0) AS built, count(*) FILTER (WHERE n_calls >= 2 AND edge) AS multi_flow, count(*) FILTER (WHERE n_calls = 2 AND edge) AS two_flow, count(*) FILTER (WHERE ok) AS executed, count(*) FILTER (WHERE ok AND right_) AS correct,
        count(*) FILTER (WHERE ok AND right_ AND n_calls >= 2 AND edge) AS multi_correct, count(*) FILTER (WHERE ok AND right_ AND n_calls = 2 AND edge) AS two_correct, round(count(*) FILTER (WHERE ok AND right_) / count(*), 4) AS coverage,
        round(count(*) FILTER (WHERE ok AND right_ AND n_calls >= 2 AND edge) / greatest(count(*) FILTER (WHERE ok AND right_), 1), 4) AS true_flow_rate, any_value(call_counts) AS call_counts FROM p2, h
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return audits.faithful_audit(_plans(spark, d), _library(spark, d))


_STEPS_OF_FAILURE = f"""{_AUDITED}, need AS (SELECT upper(trim(sub_id)) AS sub, list_transform(program.slots, lambda s: s.name) AS need FROM sub_library WHERE program IS NOT NULL),
    f AS (SELECT *, coalesce(list_position(list_transform(outs, lambda o: o.value IS NULL), true), 0) AS i FROM p2), c AS (SELECT *, CASE WHEN i > 0 THEN calls[i] END AS c FROM f),
    k AS (SELECT c.*, need, list_filter(need, lambda n: (c).bindings[n] IS NULL OR CASE WHEN (c).bindings[n].source = 'call_output' THEN len(list_filter(outs[1:i - 1], lambda o: o.call_id = (c).bindings[n].call_id)) = 0 ELSE (c).bindings[n].value IS NULL END) AS lacking
        FROM c LEFT JOIN need ON need.sub = upper(trim((c).sub_id))),
    steps_ AS (SELECT id, calls, right_, CAST(i - 1 AS BIGINT) AS step, CASE WHEN n_calls = 0 THEN 'no_plan' WHEN i = 0 THEN 'wrong_answer' WHEN need IS NULL THEN 'missing_sub' WHEN (c).bindings IS NULL OR len(lacking) > 0 THEN 'type_mismatch' ELSE 'execution_error' END AS kind FROM k)"""


@query("failure_steps", f"{_STEPS_OF_FAILURE.replace('c.*, need', 'c.*, need')} SELECT id AS plan_key, step, kind FROM steps_")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audits.failure_steps(_plans(spark, d), table(spark, d, "sub_library"), _library(spark, d)).select("plan_key", "step", "kind")


@query(
    "failure_classes",
    f"""
    {_STEPS_OF_FAILURE}, l AS (SELECT upper(trim(sub_id)) AS sub, coalesce(support, 0) AS s, coalesce(mdl_gain, 0) AS g FROM sub_library WHERE sub_id IS NOT NULL),
    m AS (SELECT list_sort(list(s))[len(list(s)) // 2 + 1] AS ms, list_sort(list(g))[len(list(g)) // 2 + 1] AS mg FROM l), w AS (SELECT sub, s >= ms AND g <= mg AS common FROM l, m),
    u AS (SELECT id, unnest(list_transform(calls, lambda c: upper(trim(c.sub_id)))) AS sub FROM steps_), n AS (SELECT u.id, count(*) AS subs, count(*) FILTER (WHERE w.sub IS NULL) AS unknown_, count(*) FILTER (WHERE common) AS common_ FROM u LEFT JOIN w USING (sub) WHERE u.sub IS NOT NULL GROUP BY 1)
    SELECT s.id AS plan_key, CASE WHEN kind IN ('no_plan', 'missing_sub') THEN 'missing_abstraction' WHEN kind = 'execution_error' THEN 'dsl_limitation' WHEN kind = 'type_mismatch' THEN 'wrong_bindings' WHEN coalesce(subs, 0) > 0 AND unknown_ > 0 THEN 'missing_abstraction'
        WHEN common_ > 0 AND common_ >= subs / 2 THEN 'spurious_subroutine' WHEN coalesce(subs, 0) > 0 THEN 'wrong_abstraction' ELSE 'missing_abstraction' END AS class FROM steps_ s LEFT JOIN n USING (id) WHERE NOT right_
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return audits.failure_classes(_plans(spark, d), table(spark, d, "sub_library"), _library(spark, d))


# --- libraries and programs ----------------------------------------------------------------------------------------


@query("library_snapshot", "SELECT count(*) AS size, string_agg(sub_id, ',' ORDER BY sub_id) AS ids, CAST(sum(coalesce(support, 0)) AS BIGINT) AS total_support, round(avg(coalesce(mdl_gain, 0)), 6) AS avg_gain FROM sub_library")
def _(spark: SparkSession, d: str) -> DataFrame:
    lib = table(spark, d, "sub_library")
    return lib.agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("sub_id")), ",").alias("ids"), F.coalesce(F.sum(F.coalesce("support", F.lit(0))), F.lit(0)).alias("total_support"), F.round(F.avg(F.coalesce("mdl_gain", F.lit(0.0))), 6).alias("avg_gain"))


@query(
    "library_minted",
    f"""
    WITH {_TYPED}, lib AS (SELECT sub_id, {_FP.replace("steps,", "program.steps,")} AS fingerprint, coalesce(support, 0) AS support FROM sub_library WHERE sub_id IS NOT NULL AND program IS NOT NULL), holder AS (SELECT fingerprint, min(sub_id) AS sub_id FROM lib GROUP BY 1),
    c AS (SELECT {_FP} AS fingerprint, count(*) AS more, min(row_id) AS o FROM p GROUP BY 1 HAVING count(*) >= 3), start AS (SELECT coalesce(max(CASE WHEN regexp_full_match(sub_id, 'L[0-9]+') THEN CAST(sub_id[2:] AS BIGINT) END), -1) + 1 AS s FROM sub_library),
    fresh AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS r FROM c WHERE fingerprint NOT IN (SELECT fingerprint FROM holder))
    SELECT lib.sub_id, lib.fingerprint, CAST(support + coalesce(more, 0) AS BIGINT) AS support, false AS is_new FROM lib LEFT JOIN (SELECT h.sub_id, more FROM c JOIN holder h USING (fingerprint)) k USING (sub_id)
    UNION ALL SELECT 'L' || CASE WHEN s + r < 10 THEN '0' ELSE '' END || (s + r), fingerprint, more, true FROM fresh, start
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The library with every program that three rows or more hold."""
    p = _programs(spark, d).withColumn("fp", growth.fingerprint(F.col("steps"))).groupBy("fp").agg(F.min_by("steps", "row_id").alias("steps"), F.count("*").alias("support"), F.min("row_id").alias("order")).where("support >= 3")
    return growth.minted(table(spark, d, "sub_library"), p)


@query(
    "op_library",
    f"WITH {_TYPED}, g AS (SELECT array_to_string(list_transform(steps, lambda s: lower(s.op)), ',') AS ops, count(*) AS support, min(row_id) AS first_id FROM p GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY support DESC, first_id) - 1 AS r FROM g) SELECT 'L' || lpad(CAST(r AS VARCHAR), 2, '0') AS sub_id, ops, support, first_id FROM r WHERE r < 16",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return audits.op_library(_programs(spark, d))


@query(
    "split_stats",
    f"""
    WITH {_COMPOUNDS.replace(_CALLS, _ATOMS)}, a AS (SELECT atom, bool_or(plan_key % 5 <> 0) AS tr, bool_or(plan_key % 5 = 0) AS te FROM atoms GROUP BY 1), c AS (SELECT compound, bool_or(plan_key % 5 <> 0) AS tr, bool_or(plan_key % 5 = 0) AS te FROM compounds GROUP BY 1)
    SELECT kind, count(*) FILTER (WHERE tr) AS n_train, count(*) FILTER (WHERE te) AS n_test, count(*) FILTER (WHERE te AND NOT tr) AS n_unseen, round(count(*) FILTER (WHERE te AND NOT tr) / count(*) FILTER (WHERE te), 4) AS unseen_rate
    FROM (SELECT 'atom' AS kind, tr, te FROM a UNION ALL SELECT 'compound', tr, te FROM c) GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Distinct atoms and compounds of both sides of a split, and those of the test side that training lacks."""
    calls = cut(_calls(spark, d))
    both = features.atoms(calls).select("plan_key", F.lit("atom").alias("kind"), F.col("atom").alias("f")).unionByName(features.compounds(calls).select("plan_key", F.lit("compound").alias("kind"), F.col("compound").alias("f")))
    per = both.groupBy("kind", "f").agg(F.bool_or(F.col("plan_key") % 5 != 0).alias("tr"), F.bool_or(F.col("plan_key") % 5 == 0).alias("te"))
    unseen = F.count_if(F.col("te") & ~F.col("tr"))
    return per.groupBy("kind").agg(F.count_if("tr").alias("n_train"), F.count_if("te").alias("n_test"), unseen.alias("n_unseen"), metrics.rate(unseen, F.count_if("te")).alias("unseen_rate"))


@query(
    "accuracy_and_length",
    f"WITH i AS ({_ONE_ITEM}) SELECT coalesce(source, '') AS source, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct, round(count(*) FILTER (WHERE correct) / count(*), 4) AS accuracy, round(avg(length(problem)), 4) AS mean_chars FROM i GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d)
    right = F.count_if(F.coalesce("correct", F.lit(False)))
    return i.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), right.alias("n_correct"), metrics.rate(right, F.count("*")).alias("accuracy"), F.round(F.avg(F.length("problem")), 4).alias("mean_chars"))


_LEAKS = f"""i AS ({_ONE_ITEM}), r AS (SELECT coalesce(source, '') AS source, exec_result AS g, map_values(bindings) AS bs FROM i WHERE bindings IS NOT NULL AND exec_result IS NOT NULL)"""


@query(
    "leakage_verdicts",
    f"WITH {_LEAKS}, s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE list_contains(bs, g)) AS n_leaking FROM r GROUP BY 1) SELECT source, n, n_leaking, round(n_leaking / n, 4) AS rate, CASE WHEN n_leaking / n > 0.5 THEN 'SUSPICIOUS' WHEN n_leaking / n > 0.3 THEN 'WATCH' ELSE 'OK' END AS verdict FROM s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Per source the rows whose bound values hold the result itself, and what to think of that."""
    i = _items(spark, d).where("bindings is not null and exec_result is not null")
    leaks = F.count_if(F.array_contains(F.map_values("bindings"), F.col("exec_result")))
    s = i.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), leaks.alias("n_leaking"))
    share = F.col("n_leaking") / F.col("n")
    return s.select("source", "n", "n_leaking", F.round(share, 4).alias("rate"), F.when(share > 0.5, "SUSPICIOUS").when(share > 0.3, "WATCH").otherwise("OK").alias("verdict"))


_COSTS = f"""{_TYPED}, withkey AS (SELECT p.*, x.template_id AS k FROM p JOIN programs x USING (row_id)), {_PLANS_BY},
    cost AS (SELECT template_id AS k, plan_key, CAST(list_sum(list_transform(calls, lambda c: length(coalesce(c.sub_id, '')) + coalesce(list_sum(list_transform(map_keys(c.bindings), lambda x: length(x) + 10)), 0))) AS BIGINT) AS cost FROM plans WHERE template_id IS NOT NULL AND len(calls) > 0),
    first AS (SELECT k, min_by(cost, plan_key) AS cost FROM cost GROUP BY 1),
    flat AS (SELECT row_id, source, k, CAST(list_sum(list_transform(steps, lambda s: length(coalesce(s.expr, '')))) + 10 * len(steps) AS BIGINT) AS flat_length FROM withkey),
    costs AS (SELECT row_id, source, flat_length, greatest(coalesce(cost, flat_length), 1) AS length, round(flat_length / greatest(coalesce(cost, flat_length), 1), 6) AS ratio FROM flat LEFT JOIN first USING (k))"""


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return audits.first_plans(_programs(spark, d), _plans_by(spark, d), "template_id")


@query("program_costs", f"WITH {_COSTS} SELECT row_id, source, flat_length, length, ratio FROM costs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _costs(spark, d)


@query(
    "compression_predictors",
    f"""
    WITH {_COSTS}, c AS (SELECT coalesce(source, '') AS source, count(*) AS n, round(avg(ratio), 6) AS compression_ratio, round(stddev_pop(ratio), 6) AS std_ratio, round(avg(flat_length), 6) AS mean_trace_length FROM costs GROUP BY 1),
    l AS (SELECT count(*) AS library_size, CAST(sum(coalesce(support, 0)) AS BIGINT) AS total_support, round(avg(coalesce(mdl_gain, 0)), 6) AS mean_gain FROM sub_library), q AS (SELECT round(avg(coalesce(len(calls), 0)), 6) AS mean_plan_depth FROM plans)
    SELECT * FROM c, l, q
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """What may predict how well a condition (here a source) does: compression, trace length, library and plan depth."""
    c = _costs(spark, d).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("compression_ratio"), F.round(F.stddev_pop("ratio"), 6).alias("std_ratio"), F.round(F.avg("flat_length"), 6).alias("mean_trace_length"))
    lib = table(spark, d, "sub_library").agg(F.count("*").alias("library_size"), F.sum(F.coalesce("support", F.lit(0))).alias("total_support"), F.round(F.avg(F.coalesce("mdl_gain", F.lit(0.0))), 6).alias("mean_gain"))
    depth = _plans(spark, d).agg(F.round(F.avg(F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0))), 6).alias("mean_plan_depth"))
    return c.crossJoin(F.broadcast(lib)).crossJoin(F.broadcast(depth))  # one row each


@query(
    "batch_rewards",
    f"""
    WITH i AS ({_ONE_ITEM}), m AS (SELECT *, coalesce(abs(exec_result - try_cast(replace(answer, ',', '') AS DOUBLE)) < 1e-3 * greatest(abs(try_cast(replace(answer, ',', '') AS DOUBLE)), 1), false) AS hit FROM i)
    SELECT item_id, CASE WHEN program IS NULL THEN 0.0 WHEN exec_result IS NULL THEN 0.1 WHEN coalesce(trim(answer), '') = '' THEN 0.5 WHEN hit THEN 1.0 ELSE 0.0 END AS reward FROM m
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Completions joined to the problems that they answer, each with its reward."""
    i = _items(spark, d)
    completions = i.select("item_id", F.col("program").isNotNull().alias("parsed"), "exec_result")
    j = completions.join(i.select("item_id", "answer"), "item_id")
    match = text.answers_match(F.col("exec_result").cast("string"), F.col("answer"), "AM-7")
    has_gold = F.coalesce(F.trim("answer"), F.lit("")) != ""
    return j.select("item_id", search.composition_reward(F.col("parsed"), F.col("exec_result").isNotNull(), has_gold, match).alias("reward"))


@query(
    "program_as_function",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """A program registered as a SQL function, which Catalyst inlines."""
    sql_function(spark, "planloom_charge", CHARGE)
    table(spark, d, "lineitem").createOrReplaceTempView("planloom_lines")
    return spark.sql("SELECT l_orderkey, l_partkey, l_linenumber, planloom_charge(l_quantity, l_extendedprice, l_discount, l_tax) AS gross FROM planloom_lines")


@query(
    "beam_of_items",
    f"WITH i AS ({_ONE_ITEM}), r AS (SELECT template_id, item_id, exec_result, row_number() OVER (PARTITION BY template_id ORDER BY exec_result DESC, item_id) AS r FROM i WHERE template_id IS NOT NULL AND exec_result IS NOT NULL) SELECT template_id, item_id, exec_result FROM r WHERE r <= 4",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.beam(_items(spark, d).where("template_id is not null and exec_result is not null"), "template_id", "exec_result", "item_id").select("template_id", "item_id", "exec_result")


@query("uniform_priors", "SELECT action, round(1.0 / (SELECT count(*) + 1 FROM sub_library), 9) AS prior FROM (SELECT sub_id AS action FROM sub_library UNION ALL SELECT 'STOP')")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The chances that a search without a model gives to each entry and to stopping."""
    lib = table(spark, d, "sub_library").where("sub_id is not null")
    n = lib.agg(F.round(1.0 / (F.count("*") + 1), 9).alias("prior"))
    actions = lib.select(F.col("sub_id").alias("action")).unionByName(spark.createDataFrame([("STOP",)], "action string"))
    return actions.crossJoin(F.broadcast(n))


@query(
    "template_coverage",
    """
    WITH t AS (SELECT template_id, domain, coalesce(reuse_count, 0) AS reuse, flatten(list_transform(coalesce(steps, []), lambda s: regexp_extract_all(lower(s.operation), '[a-z]+'))) AS ops FROM templates WHERE template_id IS NOT NULL),
    s AS (SELECT h.item_id, t.template_id, t.reuse, len(list_filter(ops, lambda o: contains(lower(h.problem), o))) + CASE WHEN contains(lower(h.problem), t.domain) THEN 2 ELSE 0 END AS score FROM heldout_items h, t),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, reuse DESC, template_id) AS r FROM s WHERE score > 0)
    SELECT item_id, template_id, CAST(score AS BIGINT) AS score FROM r WHERE r = 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return audits.template_coverage(table(spark, d, "heldout_items"), table(spark, d, "templates"), "item_id", "problem")


@query(
    "algebra_report",
    """
    WITH t AS (SELECT template_id, len(regexp_extract_all(' ' || coalesce(array_to_string(list_transform(steps, lambda s: s.expression), ' ; '), ''), '[^A-Za-z0-9_.{][0-9]+(?:\\.[0-9]+)?')) AS new_vars, coalesce(len(variables), 0) AS vars, coalesce(len(steps), 0) AS n FROM templates WHERE steps IS NOT NULL)
    SELECT count(*) AS n_templates, round(avg(new_vars), 6) AS avg_new_variables, CAST(max(new_vars) AS BIGINT) AS max_new_variables, count(*) FILTER (WHERE new_vars > 0) AS n_abstracted, round(avg(n), 6) AS avg_parts, CAST(max(n) AS BIGINT) AS max_parts, round(avg(vars), 6) AS avg_variables FROM t
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """What abstraction and decomposition make of the templates."""
    from planloom.operators import templates

    t = table(spark, d, "templates").where("steps is not null")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    j = t.join(templates.abstract(t), "template_id")
    return j.agg(
        F.count("*").alias("n_templates"), F.round(F.avg("n_new"), 6).alias("avg_new_variables"), F.max("n_new").alias("max_new_variables"), F.count_if(F.col("n_new") > 0).alias("n_abstracted"),
        F.round(F.avg(size("steps")), 6).alias("avg_parts"), F.max(size("steps")).cast("bigint").alias("max_parts"), F.round(F.avg(size("variables")), 6).alias("avg_variables"),
    )


@query(
    "candidate_scores",
    """
    WITH l AS (SELECT upper(trim(sub_id)) AS sub_id, len(program.slots) AS k, program.slots[1].name AS first, string_split(program.steps[1].expr, ' ') AS toks FROM sub_library),
    v AS (SELECT sub_id, k, toks, f, list_transform(range(1, len(toks) + 1, 2), lambda i: coalesce(try_cast(toks[i] AS DOUBLE), CASE WHEN toks[i] = first THEN f ELSE 1 END)) AS w FROM l, (SELECT unnest([1, 2]) AS f)),
    e AS (SELECT sub_id, k, f, list_reduce(list_transform(w, lambda x, i: {'op': CASE WHEN i > 1 THEN toks[2 * i - 2] ELSE '' END, 'v': CAST(x AS DOUBLE), 's': CAST(0 AS DOUBLE), 't': CAST(x AS DOUBLE)}),
        lambda a, x: {'op': '', 'v': x.v, 's': CASE WHEN x.op IN ('+', '-') THEN a.s + a.t ELSE a.s END, 't': CASE x.op WHEN '*' THEN a.t * x.v WHEN '/' THEN CASE WHEN x.v <> 0 THEN a.t / x.v END WHEN '+' THEN x.v ELSE -x.v END}) AS r FROM v),
    o AS (SELECT sub_id, any_value(k) AS k, max((r).s + (r).t) FILTER (WHERE f = 1) AS a, max((r).s + (r).t) FILTER (WHERE f = 2) AS b FROM e GROUP BY 1)
    SELECT sub_id, round(CASE WHEN a IS NULL THEN 0 ELSE 0.8 + CASE WHEN k > 1 AND b IS NOT NULL AND b <> a THEN 0.2 ELSE 0 END END, 6) AS score, a IS NOT NULL AS accepted FROM o
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each entry of the library judged as a candidate."""
    return spark.createDataFrame(growth.candidate_scores(_library(spark, d)), "sub_id string, score double, accepted boolean")


# --- search --------------------------------------------------------------------------------------------------------


def _searched(spark: SparkSession, d: str, calls: int) -> DataFrame:
    h = table(spark, d, "heldout_items").select("item_id", text.numbers(F.col("problem")).alias("numbers"), text.to_number(F.trim("answer")).alias("gold"))
    return growth.searched_plans(h, dict(sorted(_library(spark, d).items())), calls)


@query(
    "one_call_plans",
    r"""
    WITH RECURSIVE h AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(problem, '[0-9,]+\.?[0-9]*'), lambda m: try_cast(replace(m, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS v, try_cast(replace(trim(answer), ',', '') AS DOUBLE) AS gold FROM heldout_items),
    o(n, o) AS (SELECT n, [i] FROM (SELECT DISTINCT len(v) AS n FROM h) x, range(1, 100) r(i) WHERE i <= n UNION ALL SELECT n, list_append(o, i) FROM o, range(1, 100) r(i) WHERE i <= n AND len(o) < 5 AND NOT list_contains(o, i)),
    l AS (SELECT upper(trim(sub_id)) AS sub, len(program.slots) AS k, list_transform(program.slots, lambda s: s.name) AS names, list_transform(program.slots, lambda s: s.dtype) AS kinds, string_split(program.steps[1].expr, ' ') AS toks FROM sub_library),
    c AS (SELECT n, k, count(*) AS ways FROM (SELECT n, len(o) AS k FROM o) GROUP BY 1, 2),
    t AS (SELECT h.item_id, gold, l.sub, o.o, list_transform(range(1, len(toks) + 1, 2), lambda i: coalesce(try_cast(toks[i] AS DOUBLE), CASE WHEN kinds[list_position(names, toks[i])] = 'int' THEN trunc(v[o.o[list_position(names, toks[i])]]) ELSE v[o.o[list_position(names, toks[i])]] END)) AS w, toks
        FROM h JOIN l ON l.k <= len(v) JOIN c ON c.n = len(v) AND c.k = l.k AND c.ways <= 2000 JOIN o ON o.n = len(v) AND len(o.o) = l.k),
    e AS (SELECT item_id, gold, sub, o, list_reduce(list_transform(w, lambda x, i: {'op': CASE WHEN i > 1 THEN toks[2 * i - 2] ELSE '' END, 'v': CAST(x AS DOUBLE), 's': CAST(0 AS DOUBLE), 't': CAST(x AS DOUBLE)}),
        lambda a, x: {'op': '', 'v': x.v, 's': CASE WHEN x.op IN ('+', '-') THEN a.s + a.t ELSE a.s END, 't': CASE x.op WHEN '*' THEN a.t * x.v WHEN '/' THEN CASE WHEN x.v <> 0 THEN a.t / x.v END WHEN '+' THEN x.v ELSE -x.v END}) AS r FROM t),
    f AS (SELECT item_id, sub, o, (r).s + (r).t AS result FROM e WHERE CASE WHEN gold = 0 THEN abs((r).s + (r).t - gold) < 1e-3 ELSE abs((r).s + (r).t - gold) < 1e-2 * abs(gold) END)
    SELECT item_id, sub AS plan, result FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sub, o) AS r FROM f) WHERE r = 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items whose answer one call gives, with the first entry and order of the numbers that does."""
    return _searched(spark, d, 1)


@query("two_call_plans")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items whose answer two calls give, the second with the first one's output."""
    return _searched(spark, d, 2)


def _composed(spark: SparkSession, d: str) -> DataFrame:
    steps = F.transform("calls", lambda c: F.struct(c["sub_id"].alias("sub_id"), F.transform_values(F.map_filter(c["bindings"], lambda _, r: r["value"].isNotNull()), lambda _, r: r["value"]).alias("bindings")))
    return _plans(spark, d).select("plan_key", steps.alias("steps"))


@query("plan_repair")
def _(spark: SparkSession, d: str) -> DataFrame:
    return growth.repaired_plans(_composed(spark, d), dict(sorted(_library(spark, d).items())))


@query("recovery")
def _(spark: SparkSession, d: str) -> DataFrame:
    """How many of the plans that fail are repaired, and whether that is a fifth of them."""
    r = growth.repaired_plans(_composed(spark, d), dict(sorted(_library(spark, d).items())))
    failed, back = F.count_if(~F.col("ran")), F.count_if(~F.col("ran") & F.col("runs"))
    a = r.agg(F.count("*").alias("total"), F.count_if("ran").alias("ran"), failed.alias("failed"), back.alias("recovered"), metrics.rate(back, failed).alias("recovery_rate"), metrics.rate(F.count_if("runs"), F.count("*")).alias("total_rate"))
    return a.withColumn("enough", F.col("recovery_rate") >= 0.2)


@query("library_evolved")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent successful pairs of programs made into programs, checked on held-out plans (every fifth) and numbered."""
    lib, calls, plans = _library(spark, d), cut(_calls(spark, d)), _plans(spark, d)
    n_steps = table(spark, d, "sub_library").select(F.upper(F.trim("sub_id")).alias("sub"), F.size("program.steps").cast("bigint").alias("n_steps"))
    grams = library.patterns(calls.where("plan_key % 5 <> 0"), plans.select("plan_key", F.coalesce("success", F.lit(False)).alias("success")), n_steps)
    patterns = [(r.gram, r.n_success, float(r.mdl_gain)) for r in grams.orderBy(F.desc("mdl_gain"), "gram").collect()]  # at most 20
    wanted = {s for g, _, _ in patterns for s in g.split(">")}
    uses = calls.where(F.col("sub").isin(*wanted) & (F.col("plan_key") % 5 != 0)) if wanted else calls.where("false")
    values = uses.select("sub", F.explode("refs").alias("slot", "r")).where("r.source in ('quantity', 'constant')").groupBy("sub", "slot").agg(F.min("r.value").alias("value"))
    varies = {(r.sub, r.slot): r.varies for r in evolve.varying_slots(uses).collect()}  # slots of the programs of 20 pairs
    constants = {(r.sub, r.slot): r.value for r in values.collect() if r.value is not None}
    held = execute.executed_plans(plans.where("plan_key % 5 = 0"), lib, stop=False, keep=("plan_key", "calls"))
    outs = held.select("plan_key", F.posexplode("outputs").alias("pos", "o")).select("plan_key", F.col("pos").cast("bigint").alias("pos"), F.col("o.value").alias("gold"))
    w = Window.partitionBy("plan_key").orderBy("pos")
    pairs = calls.where("plan_key % 5 = 0").select("plan_key", F.lead("pos").over(w).alias("pos"), F.concat_ws(">", "sub", F.lead("sub").over(w)).alias("gram"), F.col("refs").alias("ra"), F.lead("refs").over(w).alias("rb"))
    shown = pairs.where(F.col("gram").isin(*(g for g, _, _ in patterns)) if patterns else F.lit(False)).join(outs, ["plan_key", "pos"]).where("gold is not null")
    first = Window.partitionBy("gram").orderBy("plan_key", "pos")
    rows = shown.withColumn("n", F.row_number().over(first)).where("n <= 10").collect()  # ten for each of at most 20 pairs

    def examples(program):
        subs = program.program_id[len("evolved_") :].split("-")
        out = []
        for r in rows:
            if r.gram == ">".join(subs):
                bound = {f"{s}_{k}": v.value for s, refs in zip(subs, (r.ra, r.rb)) for k, v in (refs or {}).items() if v is not None and v.value is not None}
                out.append(({s.name: bound[s.name] for s in program.slots if s.name in bound}, r.gold))
        return out

    grown = growth.evolved(patterns, lib, varies, constants, examples)
    return spark.createDataFrame([tuple(g.values()) for g in grown], "gram string, n_slots bigint, n_steps bigint, share double, support bigint, mdl_gain double, sub_id string")


# --- streams -------------------------------------------------------------------------------------------------------


@query(
    "memory_stream",
    f"""
    WITH {_UTIL}, g AS (SELECT key, count(*) AS n, round(sum(u64), 6) AS a, round(sum(u128), 6) AS b, round(sum(u256), 6) AS c FROM u GROUP BY 1)
    SELECT key, CASE greatest(a, b, c) WHEN a THEN 'u64' WHEN b THEN 'u128' ELSE 'u256' END AS action, n FROM g
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: the action that each key ends with, from the state that is kept for it."""
    events = stream(spark, d, "events")
    path = scratch(spark)
    funnels.drained(funnels.running_memory(memory_rows(events).drop("event_id", "is_test"), "key", ["u64", "u128", "u256"]), path, scratch(spark))
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("action", "n").alias("action"), F.max("n").alias("n"))


@query(
    "window_stream",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, counted by hour and type; as all come in one batch, none is late."""
    events = stream(spark, d, "events")
    path = scratch(spark)
    funnels.drained(funnels.windowed_funnel(events), path, scratch(spark))
    last = spark.read.parquet(path).groupBy("start", "event_type").agg(F.max_by("value", "n").alias("value"), F.max("n").alias("n"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
