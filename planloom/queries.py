"""The core queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.functions.types import coerce_sql
from planloom.operators import evolve, features, library, metrics, search, templates
from planloom.operators.nested import json_variant
from planloom.plans import execute
from planloom.plans.nested_plans import plan_documents, plan_links, plan_nodes, plan_tables, plan_variant
from planloom.plans.programs import MINING_TOKENS, TOKENS, Program, Slot, Step, executed, fingerprint, parsed_programs, signature, with_program
from planloom.plans.schemas import PLAN
from planloom.session import cut
from planloom.sources import files
from planloom.sources.tables import table
from planloom.streaming import funnels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("p1_found")
def _(spark: SparkSession, d: str) -> DataFrame:
    return plan_nodes(table(spark, d, "dataflow_plans"), table(spark, d, "raw_plans"))


@query(
    "p1_typed_bindings",
    """
    WITH plans AS (SELECT plan_key, any_value(calls) AS calls FROM dataflow_plans GROUP BY plan_key),
    calls AS (SELECT plan_key, generate_subscripts(calls, 1) - 1 AS call_pos, unnest(calls) AS c FROM plans),
    slots AS (SELECT plan_key, call_pos, unnest(map_entries(c.bindings)) AS e FROM calls),
    refs AS (SELECT plan_key, call_pos, e.key AS slot, e.value.source AS source, e.value.call_id AS ref_call_id FROM slots)
    SELECT r.plan_key, CAST(r.call_pos AS BIGINT) AS call_pos, r.slot, r.source,
           CAST(coalesce(max(c.call_pos), -1) AS BIGINT) AS ref_pos
    FROM refs r LEFT JOIN calls c
      ON r.source = 'call_output' AND c.plan_key = r.plan_key AND c.c.call_id = r.ref_call_id AND c.call_pos < r.call_pos
    GROUP BY r.plan_key, r.call_pos, r.slot, r.source
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = plan_documents(typed=table(spark, d, "dataflow_plans"))
    return plan_tables(docs)["bindings"].select("plan_key", "call_pos", "slot", "source", "ref_pos")


@query("p1_nodes")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Calls, bindings and finals of all plans, typed and of texts, with their surrogate keys, parents and ordinals."""
    return plan_links(plan_documents(table(spark, d, "dataflow_plans"), table(spark, d, "raw_plans")))


@query(
    "p1_typed_nodes",
    """
    WITH plans AS (SELECT plan_key, any_value(calls) AS calls, any_value(final) AS final FROM dataflow_plans WHERE plan_key IS NOT NULL GROUP BY plan_key),
    calls AS (SELECT plan_key, generate_subscripts(calls, 1) - 1 AS call_pos, unnest(calls) AS c FROM plans),
    slots AS (SELECT plan_key, call_pos, generate_subscripts(map_keys(c.bindings), 1) - 1 AS slot_pos, unnest(map_keys(c.bindings)) AS slot FROM calls)
    SELECT plan_key, 'call' AS node_kind, plan_key || '/calls/' || call_pos AS node_id, CAST(plan_key AS VARCHAR) AS parent_id, CAST(call_pos AS BIGINT) AS call_pos, CAST(-1 AS BIGINT) AS slot_pos, '' AS slot FROM calls
    UNION ALL SELECT plan_key, 'binding', plan_key || '/calls/' || call_pos || '/bindings/' || slot_pos, plan_key || '/calls/' || call_pos, CAST(call_pos AS BIGINT), CAST(slot_pos AS BIGINT), slot FROM slots
    UNION ALL SELECT plan_key, 'final', plan_key || '/final', CAST(plan_key AS VARCHAR), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), '' FROM plans WHERE final IS NOT NULL
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return plan_links(plan_documents(typed=table(spark, d, "dataflow_plans")))


# --- programs and expressions ------------------------------------------------------------------------------------

CHARGE = Program(
    "charge",
    (Slot("qty"), Slot("price"), Slot("disc"), Slot("tax")),
    (Step("compute", "net", "qty * price * (1 - disc)"), Step("compute", "gross", "net * (1 + tax)"), Step("output", "gross", "gross")),
)
CHARGE_SLOTS = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}


@query(
    "program_eval",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * l_extendedprice * (1 - l_discount) AS net, "
    "l_quantity * l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return with_program(table(spark, d, "lineitem"), CHARGE, CHARGE_SLOTS).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "net", "gross")


@query(
    "program_eval_agg",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity * l_extendedprice * (1 - l_discount) * (1 + l_tax)) / 1e6, 6) AS gross_millions
    FROM lineitem GROUP BY 1, 2
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = with_program(table(spark, d, "lineitem"), CHARGE, CHARGE_SLOTS).where("ok")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("output") / 1e6, 6).alias("gross_millions"))


@query(
    "safe_division",
    """
    SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio,
        CAST(floor(CAST(l_orderkey AS DOUBLE) / 7) AS BIGINT) AS whole, l_partkey - 5 * CAST(floor(CAST(l_partkey AS DOUBLE) / 5) AS BIGINT) AS rest, l_discount <> 0 AS ok
    FROM lineitem
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = Program(
        "safe", (Slot("a"), Slot("b"), Slot("k", "int"), Slot("m", "int")),
        (Step("compute", "whole", "k // 7", (), "int"), Step("compute", "rest", "m % 5", (), "int"), Step("output", "ratio", "a / b")),
    )
    t = with_program(table(spark, d, "lineitem"), p, {"a": "l_tax", "b": "l_discount", "k": "l_orderkey", "m": "l_partkey"})
    return t.select("l_orderkey", "l_partkey", "l_linenumber", "ratio", "whole", "rest", "ok")


_R, _T = "p_retailprice", "(p_size / 60)"
#: target: (expression, SQL of it in DuckDB); the slots are s (p_size), r (p_retailprice) and t (p_size / 60).
_BUILTINS = {
    "hi": ("max(s, 10)", "greatest(p_size, 10)"), "lo": ("min([s, 10])", "least(p_size, 10)"), "gap": ("abs(s - 25)", "abs(p_size - 25)"), "root": ("sqrt(r)", f"sqrt({_R})"),
    "middle": ("1 if 10 < s < 30 else 0", "CASE WHEN p_size BETWEEN 11 AND 29 THEN 1 ELSE 0 END"), "up": ("ceil(r / 100)", f"ceil({_R} / 100)"), "down": ("floor(r / 100)", f"floor({_R} / 100)"),
    "g": ("gcd(s, 12)", "gcd(p_size, 12)"), "total": ("sum([s, 10, 1])", "p_size + 11"), "n": ("len([s, 1, 2])", "3"), "digits": ("len(str(s))", "length(CAST(p_size AS VARCHAR))"),
    "whole": ("int(r)", f"trunc({_R})"), "real": ("float(s) / 4", "p_size / 4.0"), "truth": ("bool(s - 25)", "CAST(p_size <> 25 AS INT)"), "half": ("round(s / 2)", "round_even(p_size / 2.0, 0)"),
    "cents": ("round(r, 1)", f"round_even({_R}, 1)"), "quotient": ("divmod(s, 7)[0]", "floor(p_size / 7.0)"), "rest": ("divmod(s, 7)[1]", "p_size % 7"), "power": ("pow(s, 2)", "p_size * p_size"), "rooted": ("s ** 0.5", "sqrt(p_size)"),
    "modular": ("pow(3, s, 97)", "list_reduce(list_prepend(1, list_transform(range(p_size), lambda x: 3)), lambda a, b: a * b % 97)"), "ln": ("log(r)", f"ln({_R})"), "based": ("log(r, 7)", f"ln({_R}) / ln(7)"),
    "bits": ("log2(r)", f"log2({_R})"), "tens": ("log10(r)", f"log10({_R})"), "grown": ("exp(t)", f"exp({_T})"), "sine": ("sin(t)", f"sin({_T})"), "cosine": ("cos(t)", f"cos({_T})"), "tangent": ("tan(t)", f"tan({_T})"),
    "arcsine": ("asin(t)", f"asin({_T})"), "arccosine": ("acos(t)", f"acos({_T})"), "arctangent": ("atan(t)", f"atan({_T})"), "angle": ("atan2(t, 2)", f"atan2({_T}, 2)"), "outside": ("asin(s)", "CASE WHEN p_size <= 1 THEN asin(1.0) END"),
    "product": ("factorial(s % 10)", "CAST(factorial(p_size % 10) AS DOUBLE)"), "chosen": ("comb(s % 20, 3)", "CAST(p_size % 20 AS DOUBLE) * (p_size % 20 - 1) * (p_size % 20 - 2) / 6"), "ordered": ("perm(s % 20, 2)", "(p_size % 20) * (p_size % 20 - 1)"),
    "circle": ("pi * s", "pi() * p_size"), "euler": ("e", "exp(1.0)"), "bounded": ("min(inf, s)", "p_size"), "yes": ("True", "1"), "no": ("False", "0"),
    "both": ("s > 10 and r", f"CASE WHEN p_size > 10 THEN {_R} ELSE 0 END"), "either": ("s % 2 or 5", "CASE WHEN p_size % 2 <> 0 THEN p_size % 2 ELSE 5 END"), "neither": ("not s % 3", "CAST(p_size % 3 = 0 AS INT)"),
    "picked": ("2 if s % 2 else 3", "CASE WHEN p_size % 2 <> 0 THEN 2 ELSE 3 END"), "counted": ("(s > 10) + (s > 20)", "CAST(p_size > 10 AS INT) + CAST(p_size > 20 AS INT)"), "indexed": ("[1, s, 3][-2]", "p_size"),
}


@query("builtin_functions", "SELECT p_partkey, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 7) AS {n}" for n, (_, sql) in _BUILTINS.items()) + " FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = Program("builtins", (Slot("s", "int"), Slot("r"), Slot("t")), tuple(Step("compute", n, x) for n, (x, _) in _BUILTINS.items()))
    parts = table(spark, d, "part").withColumn("_t", F.col("p_size") / 60)
    done = with_program(parts, p, {"s": "p_size", "r": "p_retailprice", "t": "_t"})
    return done.select("p_partkey", *(F.round(n, 7).alias(n) for n in _BUILTINS))


@query(
    "coerce_types",
    """
    SELECT item_id, min(try_cast(answer AS DOUBLE)) AS f, min(CAST(trunc(try_cast(answer AS DOUBLE)) AS BIGINT)) AS i, bool_or(answer <> '') AS b
    FROM eval_results WHERE answer IS NOT NULL GROUP BY item_id
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "eval_results").where("answer is not null")
    v = t.select("item_id", F.expr(coerce_sql("answer", "float")).alias("f"), F.expr(coerce_sql("answer", "int")).alias("i"), F.expr(coerce_sql("answer", "bool", True)).alias("b"))
    return v.groupBy("item_id").agg(F.min("f").alias("f"), F.min("i").alias("i"), F.max("b").alias("b"))


_ONE_ITEM = "SELECT item_id, min(source) AS source, min(template_id) AS template_id, min(problem) AS problem, min(answer) AS answer, any_value(program) AS program, any_value(bindings) AS bindings, min(exec_result) AS exec_result, bool_or(correct) AS correct FROM eval_results GROUP BY item_id"


def _items(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    low = lambda c: F.min(c).alias(c)
    return table(spark, d, "eval_results").groupBy("item_id").agg(
        low("source"), low("template_id"), low("problem"), low("answer"), first("program"), first("bindings"), low("exec_result"), F.max("correct").alias("correct")
    )


_VALUE = "CASE WHEN {0} IN ('+', '-', '*', '/') THEN NULL WHEN list_contains(map_keys(env), {0}) THEN env[{0}] ELSE try_cast({0} AS DOUBLE) END"


@query(
    "program_rows",
    f"""
    WITH RECURSIVE t AS (SELECT item_id, program.steps AS steps, bindings, [x.name for x in program.slots] AS slots FROM ({_ONE_ITEM}) WHERE program IS NOT NULL AND bindings IS NOT NULL),
    ready AS (SELECT * FROM t WHERE len(list_filter(slots, lambda s: bindings[s] IS NULL)) = 0),
    run(item_id, steps, i, env) AS (
        SELECT item_id, steps, 1, bindings FROM ready
        UNION ALL
        SELECT item_id, steps, i + 1, map_concat(env, MAP {{steps[i].target: CASE len(string_split(steps[i].expr, ' '))
            WHEN 1 THEN env[steps[i].expr]
            ELSE CASE string_split(steps[i].expr, ' ')[2]
                WHEN '+' THEN env[string_split(steps[i].expr, ' ')[1]] + env[string_split(steps[i].expr, ' ')[3]]
                WHEN '-' THEN env[string_split(steps[i].expr, ' ')[1]] - env[string_split(steps[i].expr, ' ')[3]]
                WHEN '*' THEN env[string_split(steps[i].expr, ' ')[1]] * env[string_split(steps[i].expr, ' ')[3]] END END}})
        FROM run WHERE i <= len(steps)
    )
    SELECT item_id, env[list_filter(steps, lambda s: lower(s.op) = 'output')[-1].target] AS result FROM run WHERE i = len(steps) + 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return executed(_items(spark, d).where("bindings is not null"), "item_id").where("ok").select("item_id", "result")


@query(
    "verify_filter",
    f"""
    WITH i AS ({_ONE_ITEM})
    SELECT coalesce(source, '') AS source, count(*) AS n, count(*) FILTER (WHERE answer IS NOT NULL AND exec_result IS NOT NULL) AS n_checked,
        count(*) FILTER (WHERE CASE WHEN g = 0 THEN abs(exec_result - g) < 1e-3 ELSE abs(exec_result - g) < 1e-3 * abs(g) END) AS n_match
    FROM (SELECT *, CASE WHEN isfinite(try_cast(replace(trim(answer), ',', '') AS DOUBLE)) THEN try_cast(replace(trim(answer), ',', '') AS DOUBLE) END AS g FROM i) GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).withColumn("m", text.answers_match(F.col("exec_result").cast("string"), F.col("answer"), "AM-2"))
    return i.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count("*").alias("n"), F.count_if(F.col("answer").isNotNull() & F.col("exec_result").isNotNull()).alias("n_checked"), F.count_if("m").alias("n_match")
    )


# --- plans ---------------------------------------------------------------------------------------------------------

_PLANS = "plans AS (SELECT plan_key, any_value(calls) AS calls, any_value(final) AS final, bool_or(success) AS success FROM dataflow_plans GROUP BY plan_key)"
_CALLS = f"""{_PLANS},
    raw AS (SELECT plan_key, CAST(generate_subscripts(calls, 1) - 1 AS BIGINT) AS pos, unnest(calls) AS c FROM plans),
    calls AS (SELECT plan_key, pos, c.call_id AS call_id, upper(trim(c.sub_id)) AS sub, coalesce(list_sort(map_keys(c.bindings)), []) AS keys, c.bindings AS refs FROM raw)"""


def _plans(spark: SparkSession, d: str) -> DataFrame:
    """One row per plan."""
    return table(spark, d, "dataflow_plans").where("plan_key is not null").groupBy("plan_key").agg(F.first("calls").alias("calls"), F.first("final").alias("final"), F.max("success").alias("success"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return features.plan_calls(table(spark, d, "dataflow_plans"))


def _library(spark: SparkSession, d: str):
    return execute.library_of(table(spark, d, "sub_library"))


def _resolved(ref: str, outs: str, q: str) -> str:
    value = f"{ref}.value" if not q else f"coalesce({q.format(ref)}, {ref}.value)"
    return f"CASE {ref}.source WHEN 'call_output' THEN list_filter({outs}, lambda o: o.call_id = {ref}.call_id)[-1].value ELSE {value} END"


def _run_sql(source: str, q: str = "", stop: bool = True) -> str:
    """CTEs that run the plans (id, calls, final) of ``source`` call by call: done (id, calls, ok, made, outs, result, n_calls).

    The library's programs are one sum of products and quotients of slots and numbers each, which is folded from left to
    right: s is the sum of the finished terms, t the term so far. q: format of a quantity's value by its reference.
    """
    guard = "ok" if stop else "true"
    return f"""lib AS (SELECT upper(trim(sub_id)) AS sub, list_transform(program.slots, lambda x: x.name) AS names, list_transform(program.slots, lambda x: x.dtype) AS kinds, string_split(program.steps[1].expr, ' ') AS toks FROM sub_library),
    run(id, calls, i, ok, made, outs) AS (
        SELECT id, calls, 1, true, 0, CAST([] AS STRUCT(call_id VARCHAR, value DOUBLE)[]) FROM {source} WHERE len(calls) > 0
        UNION ALL
        SELECT id, calls, i + 1, ok AND v IS NOT NULL, made + CAST(v IS NOT NULL AS INT), list_append(outs, {{'call_id': calls[i].call_id, 'value': v}})
        FROM (SELECT *, (folded).s + (folded).t AS v FROM (SELECT *, CASE WHEN {guard} THEN list_reduce(list_transform(range(1, len(toks) + 1, 2), lambda k: {{'op': CASE WHEN k > 1 THEN toks[k - 1] ELSE '' END, 'v': w[(k + 1) // 2], 's': CAST(0 AS DOUBLE), 't': w[(k + 1) // 2]}}),
                lambda a, x: {{'op': '', 'v': x.v, 's': CASE WHEN x.op IN ('+', '-') THEN a.s + a.t ELSE a.s END, 't': CASE x.op WHEN '*' THEN a.t * x.v WHEN '/' THEN CASE WHEN x.v <> 0 THEN a.t / x.v END WHEN '+' THEN x.v ELSE -x.v END}}) END AS folded
            FROM (SELECT *, list_transform(range(1, len(toks) + 1, 2), lambda k: coalesce(try_cast(toks[k] AS DOUBLE), vals[list_position(names, toks[k])])) AS w
                FROM (SELECT r.*, toks, names, list_transform(names, lambda n, k: CASE WHEN kinds[k] = 'int' THEN trunc(list_filter(bound, lambda b: b.n = n)[1].v) ELSE list_filter(bound, lambda b: b.n = n)[1].v END) AS vals
                    FROM (SELECT r.*, list_transform(map_entries(coalesce(calls[i].bindings, MAP {{}})), lambda b: {{'n': b.key, 'v': {_resolved("b.value", "outs", q)}}}) AS bound FROM run r WHERE i <= len(calls)) r
                    LEFT JOIN lib ON lib.sub = upper(trim(calls[i].sub_id))))))
    ),
    ended AS (SELECT r.id, r.calls, r.outs, CAST(r.made AS BIGINT) AS made, r.ok AS every, CASE WHEN s.final IS NULL OR s.final.source IS NULL THEN r.outs[-1].value ELSE {_resolved("s.final", "r.outs", q)} END AS last
        FROM run r JOIN {source} s USING (id) WHERE r.i = len(r.calls) + 1),
    done AS (SELECT id, s.calls, s.final, outs, coalesce(made, 0) AS made, CAST(coalesce(len(s.calls), 0) AS BIGINT) AS n_calls, coalesce(last IS NOT NULL{" AND every" if stop else ""}, false) AS ok, CASE WHEN {"every" if stop else "true"} THEN last END AS result
        FROM {source} s LEFT JOIN ended USING (id))"""


_EACH = f"{_PLANS}, src AS (SELECT plan_key AS id, calls, final FROM plans)"
_RUN = f"WITH RECURSIVE {_EACH}, {_run_sql('src')}"


@query("plan_execute", f"{_RUN} SELECT id AS plan_key, result, ok, n_calls, made AS calls_made FROM done")
def _(spark: SparkSession, d: str) -> DataFrame:
    return execute.executed_plans(_plans(spark, d), _library(spark, d)).drop("outputs")


_FOUR = "CASE WHEN {0}.qid IN ('q0', 'q1', 'q2', 'q3') THEN CAST({0}.qid[2:] AS DOUBLE) + 2 END"


@query("plan_execute_quantities", f"WITH RECURSIVE {_EACH}, {_run_sql('src', _FOUR)} SELECT id AS plan_key, result, ok, n_calls, made AS calls_made FROM done")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = F.map_from_arrays(F.array(*(F.lit(f"q{i}") for i in range(4))), F.array(*(F.lit(float(i + 2)) for i in range(4))))
    return execute.executed_plans(_plans(spark, d), _library(spark, d), quantities=q).drop("outputs")


@query(
    "plan_consistency",
    f"""
    WITH RECURSIVE {_EACH}, {_run_sql("src", stop=False)},
    h AS (SELECT id, list_filter(list_transform(coalesce(calls, []), lambda c, i: {{'hint': c.value_hint.value, 'value': outs[i].value}}), lambda h: h.hint IS NOT NULL) AS h FROM done),
    n AS (SELECT id, len(h) AS n_hints, len(list_filter(h, lambda x: x.value IS NOT NULL AND abs(x.hint - x.value) < greatest(0.01 * abs(x.value), 1e-3))) AS good, len(list_filter(h, lambda x: x.value IS NOT NULL)) AS compared FROM h)
    SELECT id AS plan_key, n_hints, good AS n_consistent, compared - good AS n_errors, compared > 0 AND compared = good AS agreement FROM n
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return execute.consistency(_plans(spark, d), _library(spark, d))


_VARIANTS = """base AS (SELECT id, calls, final, result FROM done WHERE ok),
    each AS (SELECT id, calls, final, result, generate_subscripts(calls, 1) AS pos FROM base),
    refs AS (SELECT *, unnest(map_entries(calls[pos].bindings)) AS b FROM each),
    other AS (SELECT *, list_filter(calls[1:pos - 1], lambda p: p.call_id IS NOT NULL AND p.call_id <> b.value.call_id)[1].call_id AS o FROM refs),
    changed AS (SELECT *, CASE WHEN b.value.source = 'call_output' THEN 'edge' ELSE 'quantity' END AS kind,
        CASE WHEN b.value.source = 'call_output' THEN CASE WHEN o IS NULL THEN 'constant' ELSE 'call_output' END ELSE b.value.source END AS src_,
        CASE WHEN b.value.source = 'call_output' THEN CASE WHEN o IS NULL THEN CAST(0 AS DOUBLE) END WHEN b.value.value = 0 THEN 1 ELSE b.value.value * 2 + 7 END AS val_ FROM other),
    variants AS (SELECT {'id': id, 'pos': pos, 'slot': b.key} AS id, final, kind, result AS base_result, list_transform(calls, lambda c, i: CASE WHEN i = pos THEN {'call_id': c.call_id, 'sub_id': c.sub_id,
        'bindings': map_from_entries(list_transform(map_entries(c.bindings), lambda e: {'k': e.key, 'v': CASE WHEN e.key = b.key THEN {'source': src_, 'value': val_, 'call_id': CASE WHEN src_ = 'call_output' THEN o END, 'qid': CAST(NULL AS VARCHAR)}
            ELSE {'source': e.value.source, 'value': e.value.value, 'call_id': e.value.call_id, 'qid': e.value.qid} END}))}
        ELSE {'call_id': c.call_id, 'sub_id': c.sub_id, 'bindings': CASE WHEN c.bindings IS NOT NULL THEN map_from_entries(list_transform(map_entries(c.bindings), lambda e: {'k': e.key, 'v': {'source': e.value.source, 'value': e.value.value, 'call_id': e.value.call_id, 'qid': e.value.qid}})) END} END) AS calls FROM changed)"""


def _again(prefix: str, source: str, **options) -> str:
    """``_run_sql`` over another source with the names of its CTEs told apart."""
    sql = _run_sql(source, **options)
    for name in ("lib", "run", "ended", "done"):
        sql = re.sub(rf"\b{name}\b", f"{prefix}_{name}", sql)
    return sql


@query(
    "plan_active_bindings",
    f"""
    {_RUN}, {_VARIANTS}, {_again("again", "variants")},
    a AS (SELECT v.kind, NOT d.ok OR abs(d.result - v.base_result) > 1e-6 AS active FROM variants v JOIN again_done d USING (id))
    SELECT kind, count(*) AS n_tested, count(*) FILTER (WHERE active) AS n_active, round(count(*) FILTER (WHERE active) / count(*), 4) AS active_rate FROM a GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = execute.active_bindings(_plans(spark, d), _library(spark, d))
    return a.groupBy("kind").agg(F.count("*").alias("n_tested"), F.count_if("active").alias("n_active"), metrics.rate(F.count_if("active"), F.count("*")).alias("active_rate"))


@query("plan_inherit_variables")
def _(spark: SparkSession, d: str) -> DataFrame:
    steps = F.transform("calls", lambda c: F.struct(c["sub_id"].alias("sub_id"), F.transform_values(F.map_filter(c["bindings"], lambda _, r: r["value"].isNotNull()), lambda _, r: r["value"]).alias("bindings")))
    return execute.composed_plans(_plans(spark, d).select("plan_key", steps.alias("steps")), _library(spark, d))


@query(
    "plan_shape",
    f"""
    WITH {_PLANS}
    SELECT plan_key, CAST(coalesce(len(calls), 0) AS BIGINT) AS n_calls, coalesce(array_to_string(list_transform(calls, lambda c: upper(trim(c.sub_id))), '>'), '') AS subs,
        coalesce(len(list_filter(calls, lambda c: len(list_filter(map_values(c.bindings), lambda r: r.source = 'call_output')) > 0)) > 0, false) AS true_flow
    FROM plans
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    flow = F.exists("calls", lambda c: F.exists(F.coalesce(F.map_values(c["bindings"]), F.array()), lambda r: r["source"] == "call_output"))
    return _plans(spark, d).select(
        "plan_key", F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_calls"),
        F.coalesce(F.array_join(F.transform("calls", lambda c: F.upper(F.trim(c["sub_id"]))), ">"), F.lit("")).alias("subs"), F.coalesce(flow, F.lit(False)).alias("true_flow"),
    )


@query(
    "flow_edges",
    f"WITH {_CALLS}, e AS (SELECT plan_key, pos, call_id AS dst_call, unnest(map_entries(refs)) AS r FROM calls) "
    "SELECT plan_key, r.value.call_id AS src_call, dst_call, r.key AS slot, pos FROM e WHERE r.value.source = 'call_output'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.flow_edges(_calls(spark, d))


@query(
    "plan_constants",
    f"WITH {_CALLS}, e AS (SELECT plan_key, unnest(map_values(refs)) AS r FROM calls) SELECT r.source AS source, count(*) AS n, count(r.value) AS n_values, round(sum(r.value), 4) AS total FROM e WHERE r.source IN ('constant', 'quantity') GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    r = _calls(spark, d).select(F.explode(F.map_values("refs")).alias("r")).where("r.source in ('constant', 'quantity')")
    return r.groupBy("r.source").agg(F.count("*").alias("n"), F.count("r.value").alias("n_values"), F.round(F.sum("r.value"), 4).alias("total"))


@query(
    "edges_to_constants",
    f"""
    {_RUN}, inlined AS (
        SELECT id, final, list_transform(calls, lambda c: {{'call_id': c.call_id, 'sub_id': c.sub_id, 'bindings': CASE WHEN c.bindings IS NOT NULL THEN map_from_entries(list_transform(map_entries(c.bindings), lambda e: {{'k': e.key,
            'v': CASE WHEN e.value.source = 'call_output' AND len(list_filter(outs, lambda o: o.call_id = e.value.call_id)) > 0 THEN {{'source': 'constant', 'value': list_filter(outs, lambda o: o.call_id = e.value.call_id)[1].value, 'call_id': CAST(NULL AS VARCHAR), 'qid': e.value.qid}}
                ELSE {{'source': e.value.source, 'value': e.value.value, 'call_id': e.value.call_id, 'qid': e.value.qid}} END}})) END}}) AS calls FROM done WHERE ok), {_again("again", "inlined")}
    SELECT id AS plan_key, result, ok FROM again_done
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Plans whose references to calls are replaced by the values that those calls give, with the result they have then."""
    lib = _library(spark, d)
    done = execute.executed_plans(_plans(spark, d), lib, keep=("plan_key", "calls", "final")).where("ok")
    value = "element_at(filter(outputs, o -> o.call_id = r.call_id), 1).value"
    known = "exists(outputs, o -> o.call_id = r.call_id)"
    ref = f"named_struct('source', if(r.source = 'call_output' AND {known}, 'constant', r.source), 'value', if(r.source = 'call_output' AND {known}, {value}, r.value), 'call_id', if(r.source = 'call_output' AND {known}, CAST(NULL AS STRING), r.call_id), 'dtype', r.dtype, 'qid', r.qid, 'span', r.span, 'entity', r.entity, 'role', r.role)"
    calls = F.expr(f"transform(calls, c -> named_struct('call_id', c.call_id, 'sub_id', c.sub_id, 'bindings', transform_values(c.bindings, (k, r) -> {ref}), 'value_hint', c.value_hint))")
    again = execute.executed_plans(done.withColumn("calls", calls), lib)
    return again.select("plan_key", "result", "ok")


@query(
    "hinted_plans",
    f"WITH RECURSIVE {_EACH}, {_run_sql('src', stop=False)} SELECT id AS plan_key, CAST(generate_subscripts(outs, 1) - 1 AS BIGINT) AS pos, unnest(outs).value AS hint FROM done WHERE outs IS NOT NULL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Calls with the value that they give as their hint."""
    done = execute.executed_plans(_plans(spark, d), _library(spark, d), stop=False, keep=("plan_key", "calls"))
    hints = F.expr("transform(outputs, o -> o.value)")
    return done.select("plan_key", F.posexplode(hints).alias("pos", "hint")).select("plan_key", F.col("pos").cast("bigint").alias("pos"), (F.col("hint") + F.lit(0.0)).alias("hint"))


# --- features and splits -----------------------------------------------------------------------------------------

_GRAMS = f"""{_CALLS},
    nb AS (SELECT plan_key, pos, sub, keys, refs, call_id, lead(sub) OVER w AS s1, lead(sub, 2) OVER w AS s2, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2, lead(len(keys)) OVER w AS a1
           FROM calls WINDOW w AS (PARTITION BY plan_key ORDER BY pos))"""
_ATOMS = f"""{_CALLS},
    atoms AS (
        SELECT plan_key, atom, count(*) AS n FROM (
            SELECT plan_key, 'sub:' || sub AS atom FROM calls
            UNION ALL SELECT plan_key, 'arity:' || len(keys) FROM calls
            UNION ALL SELECT plan_key, 'type:' || coalesce(r.dtype, 'float') FROM (SELECT plan_key, unnest(map_values(refs)) AS r FROM calls) WHERE r IS NOT NULL
            UNION ALL SELECT plan_key, 'num_calls:' || count(*) FROM calls GROUP BY plan_key
        ) WHERE atom IS NOT NULL GROUP BY 1, 2)"""
_COMPOUNDS = f"""{_GRAMS},
    before AS (SELECT *, (SELECT coalesce(list(DISTINCT k), []) FROM (SELECT unnest(y.keys) AS k FROM calls y WHERE y.plan_key = nb.plan_key AND y.pos < nb.pos)) AS seen FROM nb),
    depths AS (SELECT *, least(len(list_filter(seen, lambda k: NOT list_contains(keys, k))), 3) AS depth FROM before),
    dd AS (SELECT *, lead(depth) OVER w AS d1, lead(depth, 2) OVER w AS d2 FROM depths WINDOW w AS (PARTITION BY plan_key ORDER BY pos)),
    compounds AS (
        SELECT DISTINCT plan_key, compound FROM (
            SELECT plan_key, 'bigram:' || sub || '>' || s1 AS compound FROM dd
            UNION ALL SELECT plan_key, 'trigram:' || sub || '>' || s1 || '>' || s2 FROM dd
            UNION ALL SELECT plan_key, 'flow:' || sub || '->' || s1 FROM dd
            UNION ALL SELECT plan_key, 'pos:' || pos || ':' || sub FROM dd
            UNION ALL SELECT plan_key, 'arity_pair:' || len(keys) || '>' || a1 FROM dd
            UNION ALL SELECT plan_key, 'depth_trigram:' || depth || '>' || d1 || '>' || d2 FROM dd
            UNION ALL SELECT plan_key, 'bind:' || sub || '.' || k FROM (SELECT plan_key, sub, unnest(keys) AS k FROM dd)
            UNION ALL SELECT plan_key, 'type_sig:' || sub || '(' || coalesce(array_to_string(list_sort(list_transform(map_values(refs), lambda r: coalesce(r.dtype, 'float'))), ','), NULL) || ')' FROM dd WHERE refs IS NOT NULL
            UNION ALL SELECT plan_key, 'total_calls:' || count(*) FROM dd GROUP BY plan_key
            UNION ALL SELECT x.plan_key, 'bind_flow:' || x.sub || '>' || y.sub || ':' || x.k
                FROM (SELECT plan_key, pos, sub, unnest(keys) AS k FROM dd) x JOIN (SELECT plan_key, pos, sub, unnest(keys) AS k FROM dd) y ON x.plan_key = y.plan_key AND x.k = y.k AND x.pos < y.pos
        ) WHERE compound IS NOT NULL)"""
_U = "CAST(('0x' || md5('{seed}|' || {trial} || '|' || plan_key)[1:8]) AS BIGINT) / 4294967296.0"


def _split_case(trial: str, seed: int = 42) -> str:
    u = _U.format(seed=seed, trial=trial)
    return f"CASE WHEN {u} < 0.6 THEN 'train' WHEN {u} < 0.6 + 0.2 THEN 'dev' ELSE 'test' END"


@query("bigram_counts", f"WITH {_GRAMS} SELECT concat_ws('>', sub, s1) AS gram, count(*) AS n FROM nb WHERE p1 IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.bigrams(_calls(spark, d)).groupBy("gram").agg(F.count("*").alias("n"))


@query("trigram_counts", f"WITH {_GRAMS} SELECT concat_ws('>', sub, s1, s2) AS gram, count(*) AS n FROM nb WHERE p2 IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.bigrams(_calls(spark, d), 3).groupBy("gram").agg(F.count("*").alias("n"))


@query("atoms", f"WITH {_ATOMS} SELECT plan_key, atom, n FROM atoms")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.atoms(_calls(spark, d))


@query("compounds", f"WITH {_COMPOUNDS} SELECT plan_key, compound FROM compounds")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.compounds(_calls(spark, d))


@query(
    "compound_depth",
    f"WITH {_COMPOUNDS} SELECT plan_key, pos, CAST(depth AS BIGINT) AS depth FROM depths",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.depths(_calls(spark, d)).select("plan_key", "pos", "depth")


@query(
    "shared_slots",
    f"WITH {_CALLS}, k AS (SELECT plan_key, pos, sub, unnest(keys) AS slot FROM calls) SELECT x.plan_key, x.slot, x.sub AS a, y.sub AS b, x.pos AS pos_a, y.pos AS pos_b FROM k x JOIN k y ON x.plan_key = y.plan_key AND x.slot = y.slot AND x.pos < y.pos",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.shared_slots(_calls(spark, d))


_TRUE_FLOW = f"""{_CALLS},
    edges AS (SELECT plan_key, pos, sub, e.key AS slot, e.value.call_id AS src FROM (SELECT plan_key, pos, sub, unnest(map_entries(refs)) AS e FROM calls) WHERE e.value.source = 'call_output'),
    src AS (SELECT plan_key, call_id, max_by(sub, pos) AS s FROM calls WHERE call_id IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT e.plan_key, coalesce(src.s, '?') AS a, coalesce(e.sub, '?') AS b, slot FROM edges e LEFT JOIN src ON src.plan_key = e.plan_key AND src.call_id = e.src),
    true_flow AS (
        SELECT DISTINCT plan_key, compound FROM (
            SELECT plan_key, 'sub:' || sub AS compound FROM calls WHERE sub IS NOT NULL
            UNION ALL SELECT plan_key, 'true_flow:' || a || '>' || b FROM j
            UNION ALL SELECT plan_key, 'flow_slot:' || a || '>' || b || '.' || slot FROM j
            UNION ALL SELECT plan_key, 'multicall:' || count(*) FROM calls GROUP BY plan_key HAVING count(*) > 1
        ))"""


@query("compounds_true_flow", f"WITH {_TRUE_FLOW} SELECT plan_key, compound FROM true_flow")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.true_flow(_calls(spark, d))


@query(
    "atom_tvd",
    f"""
    WITH {_ATOMS},
    per AS (SELECT atom, sum(n) FILTER (WHERE plan_key % 2 = 0) AS p, sum(n) FILTER (WHERE plan_key % 2 <> 0) AS q FROM atoms GROUP BY 1),
    tot AS (SELECT sum(p) AS ps, sum(q) AS qs FROM per)
    SELECT round(coalesce(0.5 * sum(abs(coalesce(p, 0) / ps - coalesce(q, 0) / qs)), 1.0), 9) AS tvd FROM per, tot
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.tvd(features.atoms(_calls(spark, d)), F.col("plan_key") % 2 == 0)


@query(
    "compound_divergence",
    f"""
    WITH {_COMPOUNDS}, per AS (SELECT compound, bool_or(plan_key % 5 <> 0) AS tr, bool_or(plan_key % 5 = 0) AS te FROM compounds GROUP BY 1)
    SELECT count(*) AS n_test, count(*) FILTER (WHERE NOT tr) AS n_unseen, round(coalesce(count(*) FILTER (WHERE NOT tr) / count(*), 0.0), 9) AS divergence FROM per WHERE te
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.divergence(features.compounds(_calls(spark, d)), F.col("plan_key") % 5 != 0, F.col("plan_key") % 5 == 0)


_TRIALS = f"""{_COMPOUNDS.replace(_CALLS, _ATOMS)},
    ks AS (SELECT plan_key, t AS trial FROM (SELECT DISTINCT plan_key FROM calls), range(0, {{n}}) r(t)),
    asg AS (SELECT plan_key, trial, {_split_case("trial")} AS split FROM ks),
    pa AS (SELECT trial, atom, sum(n) FILTER (WHERE split = 'train') AS p, sum(n) FILTER (WHERE split = 'test') AS q FROM atoms JOIN asg USING (plan_key) GROUP BY 1, 2),
    ta AS (SELECT trial, sum(p) AS ps, sum(q) AS qs FROM pa GROUP BY 1),
    tv AS (SELECT trial, round(0.5 * sum(abs(coalesce(p, 0) / ps - coalesce(q, 0) / qs)), 9) AS tvd FROM pa JOIN ta USING (trial) GROUP BY 1),
    pc AS (SELECT trial, compound, bool_or(split = 'train') AS tr, bool_or(split = 'test') AS te FROM compounds JOIN asg USING (plan_key) GROUP BY 1, 2),
    dv AS (SELECT trial, round(count(*) FILTER (WHERE NOT tr) / count(*), 9) AS divergence FROM pc WHERE te GROUP BY 1)"""


@query("split_trials", f"WITH {_TRIALS.format(n=500)} SELECT trial, tvd, divergence FROM tv JOIN dv USING (trial)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.trial_scores(cut(_calls(spark, d)), features.TRIALS)


@query(
    "constrained_split",
    f"""
    WITH {_TRIALS.format(n=500)},
    s AS (SELECT *, CASE WHEN tvd <= 0.02 AND divergence >= 0.1 THEN 2 WHEN tvd <= 0.04 THEN 1 ELSE 0 END AS tier FROM tv JOIN dv USING (trial)),
    b AS (SELECT trial FROM s ORDER BY tier DESC, CASE WHEN tier > 0 THEN divergence ELSE 0 END DESC, trial LIMIT 1)
    SELECT plan_key, split FROM asg JOIN b USING (trial)
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.constrained_split(cut(_calls(spark, d)))


@query(
    "unseen_compounds",
    f"WITH {_COMPOUNDS} SELECT DISTINCT compound FROM compounds WHERE plan_key % 5 = 0 AND compound NOT IN (SELECT compound FROM compounds WHERE plan_key % 5 <> 0)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = cut(features.compounds(_calls(spark, d)))
    test, train = c.where("plan_key % 5 = 0").select("compound").distinct(), c.where("plan_key % 5 <> 0").select("compound").distinct()
    return test.join(train, "compound", "left_anti")


@query(
    "hash_split",
    f"SELECT split, count(*) AS n FROM (SELECT plan_key, {_split_case('0')} AS split FROM (SELECT DISTINCT plan_key FROM dataflow_plans)) GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "dataflow_plans").select("plan_key").distinct()
    return features.assignments(keys, 1).groupBy("split").agg(F.count("*").alias("n"))


# --- texts and answers -------------------------------------------------------------------------------------------

_NUM = "(CASE WHEN isfinite(try_cast({0} AS DOUBLE)) THEN try_cast({0} AS DOUBLE) END)"


@query(
    "quantities",
    f"""
    WITH m AS (SELECT item_id, unnest(range(0, len(f))) AS i, f FROM (SELECT item_id, regexp_extract_all(problem, '[0-9,]+\\.?[0-9]*') AS f FROM heldout_items))
    SELECT item_id, 'q' || i AS qid, f[i + 1] AS span, {_NUM.format("replace(f[i + 1], ',', '')")} AS value FROM m WHERE {_NUM.format("replace(f[i + 1], ',', '')")} IS NOT NULL
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "heldout_items").select("item_id", F.explode(text.quantities(F.col("problem"))).alias("q")).select("item_id", "q.qid", "q.span", "q.value")


@query(
    "document_quantities",
    f"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9,]+\\.?[0-9]*')) AS f FROM documents)
    SELECT doc_id, count(*) AS n_matches, count({_NUM.format("replace(f, ',', '')")}) AS n_numbers, max({_NUM.format("replace(f, ',', '')")}) AS largest FROM m GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", F.explode(text.quantity_matches(F.col("text"))).alias("f"))
    v = text.to_number(F.col("f"))
    return m.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.count(v).alias("n_numbers"), F.max(v).alias("largest"))


@query(
    "bindings_positional",
    f"""
    WITH i AS (SELECT item_id, list_transform(program.slots, lambda s: s.name) AS slots, regexp_extract_all(problem, '[0-9,]+\\.?[0-9]*') AS f FROM ({_ONE_ITEM}) WHERE program IS NOT NULL AND problem IS NOT NULL),
    e AS (SELECT item_id, unnest(range(1, len(slots) + 1)) AS k, slots, f FROM i)
    SELECT item_id, slots[k] AS slot, coalesce({_NUM.format("replace(f[k], ',', '')")}, 0.0) AS value FROM e
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).where("program is not null and problem is not null")
    return i.select("item_id", F.explode(text.positional_bindings(F.col("program.slots"), F.col("problem"))).alias("slot", "value"))


_STRIP_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _cascade_sql(text: str, rule: str) -> str:
    t = _STRIP_SQL.format(text)
    looked_at = f"lower({t})" if rule == "algebra" else t
    whens = "".join(
        f" WHEN regexp_matches({looked_at}, '{q}') THEN {_STRIP_SQL.format(f"replace(regexp_extract({looked_at}, '{q}', 1), ',', '')")}"
        for q in (p.replace("(?imd)", "(?im)") for p in text_rules[rule])
    )
    last = f" ELSE {_STRIP_SQL.format(f'string_split({t}, chr(10))[-1]')}" if rule == "algebra" else ""
    return f"CASE{whens}{last} END"


text_rules = text.ANSWER_RULES


def _answers(rule: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = table(spark, d, "chat_messages").where("content is not null").select("msg_id", "content").distinct()
        return m.select("msg_id", text.extract_answer(F.col("content"), rule).alias("answer"))

    return run


for _rule, _name in (("eval", "answer_cascade"), ("algebra", "answer_cascade_algebra"), ("distill", "answer_cascade_distill")):
    query(_name, f"WITH m AS (SELECT DISTINCT msg_id, content FROM chat_messages WHERE content IS NOT NULL) SELECT msg_id, {_cascade_sql('content', _rule)} AS answer FROM m")(_answers(_rule))


@query(
    "gold_answers",
    rf"""
    WITH m AS (SELECT DISTINCT msg_id, content AS c, CASE WHEN msg_id % 3 = 0 THEN role END AS a FROM chat_messages WHERE content IS NOT NULL)
    SELECT msg_id, {_STRIP_SQL.format(r"coalesce(nullif(a, ''), CASE WHEN regexp_matches(c, '\boxed\{([^}]+)\}') THEN regexp_extract(c, '\boxed\{([^}]+)\}', 1) WHEN contains(c, '####') THEN string_split(c, '####')[-1]"
                                      r" WHEN len(regexp_extract_all(c, '[\-\d,]+\.?\d*')) > 0 THEN replace(regexp_extract_all(c, '[\-\d,]+\.?\d*')[-1], ',', '') END, '')")} AS answer FROM m
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The answer of a record that may have its own (here a third has) or a solution."""
    m = table(spark, d, "chat_messages").where("content is not null").select("msg_id", "content", F.when(F.col("msg_id") % 3 == 0, F.col("role")).alias("own")).distinct()
    return m.select("msg_id", text.gold_answer(F.col("own"), F.col("content")).alias("answer"))


@query(
    "normal_answers",
    r"""
    WITH a AS (SELECT DISTINCT item_id, answer FROM eval_results WHERE answer IS NOT NULL),
    b AS (SELECT item_id, trim(regexp_replace(coalesce(nullif(trim(regexp_extract(answer, '####\s*([^\n]+)', 1)), ''), trim(answer)), '[,$%]', '', 'g')) AS p FROM a)
    SELECT item_id, CASE WHEN isfinite(try_cast(p AS DOUBLE)) AND try_cast(p AS DOUBLE) = floor(try_cast(p AS DOUBLE)) THEN CAST(CAST(try_cast(p AS DOUBLE) AS BIGINT) AS VARCHAR)
        WHEN isfinite(try_cast(p AS DOUBLE)) THEN CAST(try_cast(p AS DOUBLE) AS VARCHAR) ELSE lower(p) END AS answer FROM b
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "eval_results").where("answer is not null").select("item_id", "answer").distinct()
    return a.select("item_id", text.normal_answer(F.col("answer")).alias("answer"))


def _match_sql() -> str:
    g, p = _NUM.format("replace(trim(gold), ',', '')"), _NUM.format("replace(trim(pred), ',', '')")
    rel = {"am1": 1e-3, "am2": 1e-3, "am3": 1e-2, "am4": 1e-2}
    cases = []
    for name in ("am1", "am2", "am3", "am4", "am5", "am7", "am8"):
        side = "lower(trim(pred)) = lower(trim(gold))" if name in ("am2", "am3", "am5", "am8") else "trim(pred) = trim(gold)"
        if name in rel:
            num = f"CASE WHEN {g} = 0 THEN abs({p} - {g}) < 1e-3 ELSE abs({p} - {g}) < {rel[name]} * abs({g}) END"
        elif name == "am7":
            num, side = f"abs({p} - {g}) < 1e-3 * greatest(abs({g}), 1)", "false"
        else:
            num = f"abs({p} - {g}) < 1e-3"
        if name == "am5":
            g5 = "coalesce(nullif(" + _cascade_sql("gold", "eval") + ", ''), gold)"
            num, side = num.replace(g, _NUM.format(f"replace(trim({g5}), ',', '')")), side.replace("trim(gold)", f"trim({g5})")
            cases.append(f"count(*) FILTER (WHERE trim({g5}) <> '' AND CASE WHEN {p} IS NOT NULL AND {_NUM.format(f"replace(trim({g5}), ',', '')")} IS NOT NULL THEN {num} ELSE {side} END) AS {name}")
            continue
        cases.append(f"count(*) FILTER (WHERE trim(gold) <> '' AND CASE WHEN {p} IS NOT NULL AND {g} IS NOT NULL THEN {num} ELSE {side} END) AS {name}")
    return f"WITH i AS ({_ONE_ITEM}), x AS (SELECT CAST(exec_result AS BIGINT) AS e, answer AS gold, CAST(CAST(round_even(exec_result, 0) AS BIGINT) AS VARCHAR) AS pred FROM i) SELECT count(*) AS n, {', '.join(cases)} FROM x"


@query("answer_match_rules", _match_sql())
def _(spark: SparkSession, d: str) -> DataFrame:
    x = _items(spark, d).select(F.col("answer").alias("gold"), F.bround("exec_result", 0).cast("bigint").cast("string").alias("pred"))
    rules = {f"am{i}": f"AM-{i}" for i in (1, 2, 3, 4, 5, 7, 8)}
    return x.agg(F.count("*").alias("n"), *(F.count_if(text.answers_match(F.col("pred"), F.col("gold"), r)).alias(k) for k, r in rules.items()))


ANCHORS = ("buy", "cart", "cold", "cut", "each", "give", "lost", "more", "road", "sold", "total", "times")


@query(
    "template_key",
    f"""
    WITH t AS (SELECT item_id, lower(coalesce(problem, '')) AS p, list_filter({list(ANCHORS)}, lambda a: contains(lower(coalesce(problem, '')), a)) AS h FROM heldout_items)
    SELECT item_id, coalesce(nullif(array_to_string(list_sort(list_distinct(CASE WHEN len(h) > 0 THEN h ELSE regexp_extract_all(p, '[a-z]+')[1:2] END))[1:4], '|'), ''), 'misc') AS key FROM t
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "heldout_items").select("item_id", text.template_key(F.col("problem"), ANCHORS).alias("key"))


@query(
    "training_texts",
    "SELECT item_id, 'Problem: ' || problem || chr(10) || chr(10) || CASE WHEN contains(answer, '####') THEN answer ELSE '#### ' || answer END AS text FROM heldout_items WHERE problem IS NOT NULL AND answer IS NOT NULL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "heldout_items").where("problem is not null and answer is not null")
    return h.select("item_id", text.rendered(F.col("problem"), F.col("answer")).alias("text"))


# --- libraries and mining ----------------------------------------------------------------------------------------



def _signature_sql(tokens: tuple[str, ...]) -> str:
    return f"lower(s.op) || ':' || array_to_string(list_sort(list_transform(list_filter({list(tokens)}, lambda t: contains(s.expr, t)), lambda t: rtrim(t, '('))), '|')"


_SIG, _MINED = _signature_sql(TOKENS), _signature_sql(MINING_TOKENS)
#: Programs of all rows: the typed one, or where a row has none, that of its JSON text.
_TYPED = """texts AS (SELECT row_id, source, slots, steps, CASE WHEN slots IS NULL AND steps IS NULL THEN json_transform(try_cast(output AS JSON),
        '{"slots": [{"name": "VARCHAR", "dtype": "VARCHAR", "description": "VARCHAR"}], "steps": [{"op": "VARCHAR", "target": "VARCHAR", "expr": "VARCHAR", "inputs": ["VARCHAR"], "target_dtype": "VARCHAR"}]}') END AS o FROM programs),
    p AS (SELECT row_id, source, coalesce(slots, o.slots) AS slots, coalesce(steps, o.steps) AS steps FROM texts WHERE len(coalesce(steps, o.steps)) > 0)"""
_STEPS = f"{_TYPED}, st AS (SELECT row_id, CAST(generate_subscripts(steps, 1) - 1 AS BIGINT) AS pos, unnest(steps) AS s FROM p), sg AS (SELECT row_id, pos, lower(s.op) AS op, s.target AS target, s.expr AS expr, s.inputs AS inputs, {_SIG} AS sig FROM st)"
_FP = "md5(array_to_string(list_transform(steps, lambda s: s.op || ':' || s.expr), '|'))[1:12]"


def _programs(spark: SparkSession, d: str) -> DataFrame:
    """The programs of all rows, typed or text."""
    return parsed_programs(table(spark, d, "programs")).where("steps is not null and size(steps) > 0")


def _dtype_ops(c):
    return F.array_join(F.transform(c, lambda s: s["dtype"]), ",")


@query("library_add", f"WITH {_TYPED} SELECT {_FP} AS fingerprint, count(*) - 1 AS support, min(row_id) AS first_id FROM p GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.add_all(_programs(spark, d))


@query(
    "library_stats",
    f"""
    SELECT count(*) AS size, CAST(coalesce(sum(support), 0) AS BIGINT) AS total_support, round(coalesce(avg(support), 0), 6) AS avg_support, round(coalesce(avg(len(program.steps)), 0), 6) AS avg_steps,
        count(DISTINCT {_FP.replace("steps,", "program.steps,")}) AS distinct_programs, round(count(DISTINCT {_FP.replace("steps,", "program.steps,")}) / count(*), 6) AS diversity,
        round(coalesce(avg(mdl_gain), 0), 6) AS avg_gain FROM sub_library
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.stats(table(spark, d, "sub_library"))


@query("library_next_id", "SELECT coalesce(max(CASE WHEN regexp_full_match(sub_id, 'L[0-9]+') THEN CAST(sub_id[2:] AS BIGINT) END), -1) + 1 AS next_id FROM sub_library")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.next_id(table(spark, d, "sub_library"))


@query("library_prune", "SELECT sub_id, support, mdl_gain FROM sub_library WHERE coalesce(support, 0) >= 10 AND coalesce(mdl_gain, 0) >= 2.0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.prune(table(spark, d, "sub_library"), 10, 2.0).select("sub_id", "support", "mdl_gain")


@query("library_signatures", "SELECT sub_id, sub_id || '(' || array_to_string(list_transform(program.slots, lambda s: s.name || ': ' || s.dtype), ', ') || ')' AS signature FROM sub_library")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sub_library").select("sub_id", signature(F.col("sub_id"), F.col("program.slots")).alias("signature"))


@query("library_untyped", "SELECT sub_id, array_to_string(list_transform(program.slots, lambda s: 'float'), ',') AS dtypes FROM sub_library")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.untyped(table(spark, d, "sub_library")).select("sub_id", _dtype_ops("program.slots").alias("dtypes"))


@query(
    "library_shuffled_types",
    """
    SELECT sub_id, array_to_string(list_transform(list_sort(list_transform(range(1, len(program.slots) + 1), lambda i: {'h': md5('42|' || sub_id || '|' || (i - 1)), 'd': program.slots[i].dtype})), lambda x: x.d), ',') AS dtypes
    FROM sub_library
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.shuffled_types(table(spark, d, "sub_library")).select("sub_id", _dtype_ops("program.slots").alias("dtypes"))


@query("library_random", "SELECT sub_id FROM sub_library ORDER BY md5('42|' || sub_id), sub_id LIMIT 16")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.random_entries(table(spark, d, "sub_library"), 16).select("sub_id")


@query("fingerprints", f"WITH {_TYPED} SELECT row_id, {_FP} AS fingerprint FROM p")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _programs(spark, d).select("row_id", fingerprint(F.col("steps")).alias("fingerprint"))


@query("step_signatures", f"WITH {_STEPS} SELECT sig, count(*) AS n FROM sg GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.program_steps(_programs(spark, d)).groupBy("sig").agg(F.count("*").alias("n"))


_WHOLE = f"""{_TYPED}, w AS (SELECT row_id, source, CAST(coalesce(len(slots), 0) AS BIGINT) AS n_slots, array_to_string(list_transform(steps, lambda s: {_MINED}), ';') AS sig FROM p)"""


@query(
    "library_mining",
    f"""
    WITH {_WHOLE}, g AS (SELECT sig, n_slots, count(*) AS support, min(row_id) AS first_id FROM w GROUP BY 1, 2 HAVING count(*) >= 3),
    top AS (SELECT *, row_number() OVER (ORDER BY support DESC, first_id) AS rank FROM g),
    src AS (SELECT sig, n_slots, source, row_number() OVER (PARTITION BY sig, n_slots ORDER BY CASE WHEN source IS NULL THEN 0 ELSE count(*) END DESC, min(row_id)) AS r FROM w GROUP BY 1, 2, 3)
    SELECT rank, sig, n_slots, support, source AS main_source, first_id FROM top JOIN src USING (sig, n_slots) WHERE r = 1 AND rank <= 64
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.mine_whole(_programs(spark, d))


@query(
    "subsequence_mining",
    f"""
    WITH {_TYPED}, w2 AS (SELECT DISTINCT array_to_string(list_transform(steps, lambda s: {_MINED}), ';') AS part FROM p),
    st AS (SELECT row_id, len(steps) AS n, generate_subscripts(steps, 1) AS pos, unnest(steps) AS s FROM p),
    sg AS (SELECT row_id, n, pos, lower(s.op) AS op, s.target AS t, coalesce(s.inputs, []) AS i, {_MINED} AS sig FROM st),
    a AS (SELECT n, sig, i, t, lead(sig) OVER w AS sig1, lead(i) OVER w AS i1, lead(t) OVER w AS t1, lead(op) OVER w AS op1, lead(sig, 2) OVER w AS sig2, lead(i, 2) OVER w AS i2, lead(op, 2) OVER w AS op2
        FROM sg WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
    r AS (
        SELECT sig || ';' || sig1 AS part, 2 AS length, list_concat(i, list_filter(i1, lambda x: x <> t)) AS free FROM a WHERE n > 2 AND op1 <> 'output'
        UNION ALL SELECT sig || ';' || sig1 || ';' || sig2, 3, list_concat(i, list_filter(i1, lambda x: x <> t), list_filter(i2, lambda x: x <> t AND x <> t1)) FROM a WHERE n > 3 AND op2 <> 'output'
    )
    SELECT part, CAST(length AS BIGINT) AS length, CAST(len(list_distinct(free)) AS BIGINT) AS n_inputs, count(*) AS support FROM r WHERE part NOT IN (SELECT part FROM w2) GROUP BY 1, 2, 3 HAVING count(*) >= 3
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.mine_parts(_programs(spark, d))


_CANONICAL = """prim AS (
        SELECT row_id, pos, op, target, list_filter(list_distinct(coalesce(inputs, [])), lambda n: regexp_full_match(n, '[A-Za-z_][A-Za-z_0-9]*')) AS unsorted, inputs, expr FROM sg WHERE op <> 'output' AND expr IS NOT NULL),
    ins AS (SELECT *, list_filter(inputs, lambda n, i: list_contains(unsorted, n) AND list_position(inputs, n) = i) AS ins FROM prim),
    can AS (SELECT *, len(coalesce(ins, [])) AS arity, regexp_replace(list_reduce(list_concat([expr], coalesce(ins, [])), lambda e, n, i: regexp_replace(e, '\\b' || n || '\\b', chr(1) || (i - 2) || chr(2), 'g')), '\\x01([0-9]+)\\x02', 'a\\1', 'g') AS canonical FROM ins)"""


@query("step_primitives", f"WITH {_STEPS}, {_CANONICAL} SELECT op, canonical, CAST(arity AS BIGINT) AS arity, count(*) AS support FROM can GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.step_primitives(_programs(spark, d))


@query("frequency_topk", f"WITH {_TYPED} SELECT {_FP} AS fingerprint, count(*) AS n, max(row_id) AS last_id FROM p GROUP BY 1 ORDER BY n DESC, last_id LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.frequency_top(_programs(spark, d))


@query(
    "uncompressed_bank",
    f"WITH {_TYPED}, f AS (SELECT {_FP} AS fp, len(steps) AS n_steps, min(row_id) AS first_id FROM p GROUP BY 1, 2) "
    "SELECT first_id, n_steps, round(abs(n_steps - (SELECT avg(len(steps)) FROM p)), 6) AS gap FROM f ORDER BY gap, first_id LIMIT 16",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.uncompressed(_programs(spark, d))


@query(
    "pattern_mining_mdl",
    f"""
    WITH {_GRAMS}, b AS (SELECT nb.plan_key, sub AS a, s1 AS b, coalesce(plans.success, false) AS ok FROM nb JOIN plans USING (plan_key) WHERE sub IS NOT NULL AND s1 IS NOT NULL),
    per AS (SELECT a, b, count(*) FILTER (WHERE ok) AS n_success, count(*) FILTER (WHERE NOT ok) AS n_failure, count(DISTINCT plan_key) AS usage FROM b GROUP BY 1, 2 HAVING count(*) FILTER (WHERE ok) >= 3 ORDER BY n_success DESC, a, b LIMIT 20),
    l AS (SELECT upper(trim(sub_id)) AS sub, len(program.steps) AS n FROM sub_library)
    SELECT a || '>' || b AS gram, n_success, n_failure, round(n_success / (n_success + n_failure), 6) AS success_rate, usage,
        (coalesce(la.n, 0) + coalesce(lb.n, 0) - 1) * usage - (coalesce(la.n, 0) + coalesce(lb.n, 0)) AS mdl_gain
    FROM per LEFT JOIN l la ON la.sub = a LEFT JOIN l lb ON lb.sub = b
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    plans = _plans(spark, d)
    steps = table(spark, d, "sub_library").select(F.upper(F.trim("sub_id")).alias("sub"), F.size("program.steps").cast("bigint").alias("n_steps"))
    return library.patterns(_calls(spark, d), plans.select("plan_key", F.coalesce("success", F.lit(False)).alias("success")), steps)


_OPS_SEQ = "array_to_string(list_transform({0}, lambda s: lower(s.op)), ',')"


@query(
    "matched_subroutine",
    f"WITH {_TYPED}, l AS (SELECT {_OPS_SEQ.format('program.steps')} AS seq, min(sub_id) AS sub_id FROM sub_library GROUP BY 1) SELECT row_id, sub_id FROM p JOIN l ON {_OPS_SEQ.format('steps')} = seq",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.matched_subroutine(_programs(spark, d), table(spark, d, "sub_library"))


_COVER = f"""{_TYPED}, l AS (SELECT list_transform(list_filter(program.steps, lambda s: lower(s.op) <> 'output'), lambda s: lower(s.op)) AS ops, min(sub_id) AS id FROM sub_library WHERE sub_id IS NOT NULL GROUP BY 1),
    known AS (SELECT list({{'n': len(ops), 'id': id, 'ops': ops}} ORDER BY len(ops) DESC, id) AS known FROM l WHERE len(ops) > 0),
    o AS (SELECT row_id, list_transform(list_filter(steps, lambda s: lower(s.op) <> 'output'), lambda s: lower(s.op)) AS ops FROM p),
    run(row_id, ops, i, cover, n) AS (
        SELECT row_id, ops, CAST(1 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM o
        UNION ALL
        SELECT row_id, ops, i + coalesce(e.n, 1), CASE WHEN e IS NULL THEN cover ELSE list_append(cover, e.id) END, n + coalesce(e.n, 0)
        FROM (SELECT r.*, list_filter(k.known, lambda e: r.ops[r.i:r.i + e.n - 1] = e.ops)[1] AS e FROM run r, known k WHERE r.i <= len(r.ops))
    ),
    ended AS (SELECT row_id, cover, n AS covered, CAST(len(ops) AS BIGINT) AS n_steps FROM run WHERE i > len(ops))"""


@query("greedy_cover", f"WITH RECURSIVE {_COVER} SELECT row_id, array_to_string(cover, '>') AS cover, covered, n_steps FROM ended")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.greedy_cover(_programs(spark, d), table(spark, d, "sub_library"))


@query(
    "compression_ratio",
    f"""
    WITH RECURSIVE {_COVER}, f AS (SELECT row_id, CAST(list_sum(list_transform(steps, lambda s: length(coalesce(s.expr, '')))) + 10 * len(steps) AS BIGINT) AS flat FROM p),
    r AS (SELECT (10 * len(cover) + flat * (n_steps - covered) / greatest(n_steps, 1)) / flat AS r FROM f JOIN ended USING (row_id))
    SELECT count(*) AS n, round(avg(r), 6) AS mean_ratio, round(quantile_disc(r, 0.5), 6) AS median_ratio, round(stddev_pop(r), 6) AS std_ratio FROM r
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _programs(spark, d)
    return metrics.compression(p, library.greedy_cover(p, table(spark, d, "sub_library")))


@query(
    "subroutine_usage",
    f"WITH {_CALLS} SELECT l.sub_id, count(c.sub) AS n_calls, count(DISTINCT c.plan_key) AS n_plans, min(c.plan_key) AS example FROM sub_library l LEFT JOIN calls c ON c.sub = upper(trim(l.sub_id)) GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lib = table(spark, d, "sub_library").select("sub_id", F.upper(F.trim("sub_id")).alias("sub"))
    per = _calls(spark, d).groupBy("sub").agg(F.count("*").alias("n"), F.countDistinct("plan_key").alias("p"), F.min("plan_key").alias("example"))
    return lib.join(per, "sub", "left").select("sub_id", F.coalesce("n", F.lit(0)).alias("n_calls"), F.coalesce("p", F.lit(0)).alias("n_plans"), "example")


# --- templates ---------------------------------------------------------------------------------------------------


@query("template_bank", f"SELECT md5(array_to_string(list_transform(steps, lambda s: s.operation || ':' || s.expression), '|'))[1:12] AS fingerprint, min(template_id) AS first_id, CAST(sum(coalesce(reuse_count, 0)) AS BIGINT) AS reuse, count(*) AS n_sources, array_to_string(list_sort(list(DISTINCT template_id)), ',') AS sources FROM templates WHERE steps IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.bank(table(spark, d, "templates"))


@query(
    "template_bank_stats",
    "SELECT coalesce(domain, '') AS domain, count(*) AS n, round(avg(coalesce(len(steps), 0)), 6) AS avg_steps, round(avg(coalesce(len(variables), 0)), 6) AS avg_variables, CAST(coalesce(sum(reuse_count), 0) AS BIGINT) AS total_reuse FROM templates GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.bank_stats(table(spark, d, "templates"))


@query("template_search", "SELECT template_id, reuse_count FROM templates WHERE domain = 'trade' AND reuse_count >= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.search(table(spark, d, "templates"), "trade", 3).select("template_id", "reuse_count")


@query(
    "template_instantiate",
    """
    WITH t AS (SELECT template_id, list_transform(variables, lambda v: v.name) AS names, unnest(steps) AS s FROM templates WHERE variables IS NOT NULL)
    SELECT template_id, CAST(s.step_id AS BIGINT) AS step_id, s.operation AS operation,
        CASE WHEN len(names) = 0 THEN s.expression ELSE list_reduce(list_concat([s.expression], names), lambda e, n: replace(e, '{' || n || '}', CAST(length(n) AS VARCHAR))) END AS expression FROM t
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_distinct(F.transform("variables", lambda v: v["name"]))
    b = F.map_from_arrays(names, F.transform(names, lambda n: F.length(n).cast("string")))
    return templates.instantiate(table(spark, d, "templates").where("variables is not null"), b)


@query(
    "template_specialize",
    """
    SELECT template_id, array_to_string(list_transform(list_filter(variables, lambda v: v.name <> variables[1].name), lambda v: v.name), ',') AS variables,
        array_to_string(list_transform(steps, lambda s: replace(s.expression, '{' || variables[1].name || '}', '7')), ';') AS expressions
    FROM templates WHERE variables[1].name IS NOT NULL
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.specialize(table(spark, d, "templates"), F.expr("get(variables, 0).name"), F.lit("7"))


@query(
    "template_decompose",
    """
    SELECT template_id, CAST(s.step_id AS BIGINT) AS step_id, s.operation AS operation,
        array_to_string(list_transform(list_filter(variables, lambda v: contains(s.expression, '{' || v.name || '}')), lambda v: v.name), ',') AS variables
    FROM (SELECT template_id, variables, unnest(steps) AS s FROM templates)
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.decompose(table(spark, d, "templates"))


@query(
    "template_compose",
    """
    WITH t AS (SELECT template_id, coalesce(list_transform(variables, lambda v: v.name), []) AS v, coalesce(list_transform(steps, lambda s: s.output_var), []) AS made, coalesce(list_transform(steps, lambda s: s.expression), []) AS e FROM templates WHERE template_id IS NOT NULL),
    c AS (SELECT a.template_id AS id_a, len(a.e) + len(b.e) AS n_steps, list_distinct(list_concat(a.v, list_filter(b.v, lambda n: NOT list_contains(a.made, n)))) AS v, length(array_to_string(list_concat(a.e, b.e), ' ; ')) AS chars FROM t a JOIN t b ON a.template_id <> b.template_id)
    SELECT id_a, count(*) AS n_composed, CAST(sum(n_steps) AS BIGINT) AS n_steps, CAST(sum(len(v)) AS BIGINT) AS n_variables, CAST(sum(chars) AS BIGINT) AS n_chars FROM c GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every two templates composed; of each first one, sums over what it gives with all others."""
    t = table(spark, d, "templates").where("template_id is not null").withColumn("_all", F.lit(1))
    c = templates.composed(t, t, "_all").where("id_a <> id_b")
    return c.groupBy("id_a").agg(F.count("*").alias("n_composed"), F.sum(F.size("steps")).alias("n_steps"), F.sum(F.size("variables")).alias("n_variables"), F.sum(F.length(F.array_join("steps", " ; "))).alias("n_chars"))


@query(
    "template_compose_steps",
    """
    WITH t AS (SELECT template_id, domain, coalesce(variables, []) AS v, coalesce(steps, []) AS s, row_number() OVER (PARTITION BY domain ORDER BY template_id) AS r FROM templates WHERE domain IS NOT NULL)
    SELECT a.template_id AS id_a, b.template_id AS id_b, array_to_string(list_transform(a.v, lambda x: x.name), ',') AS first_variables,
        array_to_string(list_concat(list_transform(a.s, lambda x, i: i || ':' || x.expression), list_transform(b.s, lambda x, i: (i + len(a.s)) || ':' || x.expression)), ' ; ') AS steps
    FROM t a JOIN t b ON a.domain = b.domain AND b.r = a.r + 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each template composed with the next one of its domain, steps numbered anew."""
    t = table(spark, d, "templates").where("domain is not null")
    w = Window.partitionBy("domain").orderBy("template_id")
    after = t.withColumn("_next", F.concat_ws("|", "domain", F.row_number().over(w).cast("string")))
    before = t.withColumn("_next", F.concat_ws("|", "domain", (F.row_number().over(w) + 1).cast("string")))
    c = templates.composed(before, after, "_next")
    return c.select("id_a", "id_b", F.array_join("v_a", ",").alias("first_variables"), F.array_join(F.transform("steps", lambda e, i: F.concat((i + 1).cast("string"), F.lit(":"), e)), " ; ").alias("steps"))


def _chains_sql() -> str:
    parts = []
    for k in range(2, 6):
        ids = ", ".join(f"lead(id, {i}) OVER w" for i in range(k))
        free = "list_concat(" + ", ".join(["v"] + [f"list_filter(lead(v, {i}) OVER w, lambda x: NOT list_contains(list_concat({', '.join(f'lead(m, {j}) OVER w' for j in range(i))}), x))" for i in range(1, k)]) + ")"
        parts.append(f"SELECT concat_ws('>', {ids}) AS chain, CAST({k} AS BIGINT) AS length, {' + '.join(f'lead(n, {i}) OVER w' for i in range(k))} AS n_steps, {free} AS f, lead(id, {k - 1}) OVER w AS last FROM t WINDOW w AS (PARTITION BY domain ORDER BY id)")
    return (
        "WITH t AS (SELECT domain, template_id AS id, coalesce(list_transform(variables, lambda x: x.name), []) AS v, coalesce(list_transform(steps, lambda x: x.output_var), []) AS m, coalesce(len(steps), 0) AS n FROM templates WHERE domain IS NOT NULL),"
        f" c AS ({' UNION ALL '.join(parts)}) SELECT chain, length, n_steps, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS variables FROM c WHERE last IS NOT NULL"
    )


@query("template_chains", _chains_sql())
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.chains(table(spark, d, "templates"))


@query(
    "template_merge",
    """
    WITH v AS (SELECT coalesce(domain, '') AS grp, array_to_string(list_sort(list(DISTINCT v.name)), ',') AS variables FROM (SELECT domain, unnest(variables) AS v FROM templates) GROUP BY 1),
    s AS (SELECT coalesce(domain, '') AS grp, array_to_string(list_sort(list(DISTINCT s.operation || ':' || s.expression)), ';') AS steps FROM (SELECT domain, unnest(steps) AS s FROM templates) GROUP BY 1)
    SELECT grp, variables, steps FROM v JOIN s USING (grp)
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.merge(table(spark, d, "templates"))


@query(
    "template_shared_variables",
    """
    WITH t AS (SELECT domain, template_id AS id, coalesce(list_transform(variables, lambda x: x.name), []) AS v FROM templates WHERE domain IS NOT NULL),
    j AS (SELECT id AS id_a, v, lead(id) OVER w AS id_b, lead(v) OVER w AS v2 FROM t WINDOW w AS (PARTITION BY domain ORDER BY id))
    SELECT id_a, id_b, array_to_string(list_filter(v, lambda x: list_contains(v2, x)), ',') AS shared FROM j WHERE id_b IS NOT NULL
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.shared_variables(table(spark, d, "templates"))


@query(
    "template_abstract",
    r"""
    WITH t AS (SELECT template_id, regexp_extract_all(array_to_string(list_transform(steps, lambda s: s.expression), ' ; '), '\{[^}]*\}|[A-Za-z_]\w*|\d+(?:\.\d+)?|(?s:.)') AS k FROM templates WHERE steps IS NOT NULL)
    SELECT template_id, coalesce(array_to_string(list_transform(k, lambda x, i: CASE WHEN regexp_full_match(x, '\d+(\.\d+)?') THEN '{c' || (len(list_filter(k[1:i], lambda y: regexp_full_match(y, '\d+(\.\d+)?'))) - 1) || '}' ELSE x END), ''), '') AS expressions,
        CAST(len(list_filter(k, lambda y: regexp_full_match(y, '\d+(\.\d+)?'))) AS BIGINT) AS n_new FROM t
    """.replace("\\\\", "\\"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.abstract(table(spark, d, "templates"))


@query(
    "template_keywords",
    """
    WITH k AS (SELECT template_id, unnest(list_distinct(list_concat(regexp_extract_all(lower(coalesce(name, '')), '[a-z]{4,}'), CASE WHEN domain IS NULL THEN [] ELSE [lower(domain)] END))) AS word FROM templates)
    SELECT word, count(*) AS n_templates, min(template_id) AS first_id FROM k GROUP BY 1 ORDER BY n_templates DESC, word LIMIT 20
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return templates.keyword_index(table(spark, d, "templates"))


# --- evaluation --------------------------------------------------------------------------------------------------


@query("raw_plan_funnel")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold JSON, a plan, a typed plan with calls, and one that runs, by model."""
    raw = table(spark, d, "raw_plans").groupBy("plan_key").agg(F.max("plan_data").alias("plan_data"), F.max("model").alias("model"))
    v = raw.select("plan_key", F.coalesce("model", F.lit("")).alias("model"), json_variant(F.col("plan_data")).alias("v"), plan_variant(F.col("plan_data")).alias("plan"))
    typed = v.select("*", F.try_variant_get("plan", "$", PLAN.simpleString()).alias("p")).select("plan_key", "model", "v", "plan", "p.calls", "p.final")
    run = execute.executed_plans(typed, _library(spark, d), keep=("plan_key", "model", "v", "plan", "calls"))
    stages = {"valid_json": F.col("v").isNotNull(), "valid_plan": F.col("plan").isNotNull(), "typed_calls": F.size("calls") > 0, "executable": F.col("ok")}
    return metrics.funnel(run, stages, ["model"])


@query(
    "item_funnel",
    f"""
    WITH i AS ({_ONE_ITEM}), f AS (SELECT coalesce(source, '') AS source, program IS NOT NULL AS a, program IS NOT NULL AND exec_result IS NOT NULL AS b, program IS NOT NULL AND exec_result IS NOT NULL AND coalesce(correct, false) AS c FROM i)
    SELECT source, count(*) AS total, count(*) FILTER (WHERE a) AS parsed, round(count(*) FILTER (WHERE a) / count(*), 4) AS parsed_rate,
        count(*) FILTER (WHERE b) AS executed, round(count(*) FILTER (WHERE b) / count(*), 4) AS executed_rate, count(*) FILTER (WHERE c) AS correct, round(count(*) FILTER (WHERE c) / count(*), 4) AS correct_rate
    FROM f GROUP BY 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).withColumn("source", F.coalesce("source", F.lit("")))
    return metrics.funnel(i, {"parsed": F.col("program").isNotNull(), "executed": F.col("exec_result").isNotNull(), "correct": F.col("correct")}, ["source"])


@query(
    "majority_vote",
    f"""
    WITH i AS ({_ONE_ITEM}), v AS (SELECT template_id, exec_result AS answer, count(*) AS n, min(item_id) AS first FROM i WHERE template_id IS NOT NULL AND exec_result IS NOT NULL GROUP BY 1, 2)
    SELECT template_id, answer, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY n DESC, first) AS r FROM v) WHERE r = 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).where("template_id is not null").withColumnRenamed("answer", "_a").withColumnRenamed("exec_result", "answer")
    return metrics.majority(i, "template_id", "answer", "item_id")


_PER_TEMPLATE = f"WITH i AS ({_ONE_ITEM}), per AS (SELECT template_id, count(*) AS n, count(*) FILTER (WHERE correct) AS c FROM i WHERE template_id IS NOT NULL GROUP BY 1)"


@query(
    "pass_at_k",
    f"{_PER_TEMPLATE} SELECT count(*) AS n_keys, round(avg(CASE WHEN n - c < 2 THEN CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END ELSE 1 - ((n - c) / n) * ((n - c - 1) / (n - 1)) END), 9) AS pass_at_k FROM per",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pass_at_k(_items(spark, d).where("template_id is not null"), "template_id", F.coalesce("correct", F.lit(False)), 2)


@query(
    "pass_at_k_reference",
    f"""{_PER_TEMPLATE} SELECT count(*) AS n_keys, round(avg(CASE WHEN c = 0 THEN 0.0 WHEN c >= 2 THEN 1.0 ELSE 1 - (CASE WHEN n - c > 0 THEN (n - c) / n ELSE 1 END) * (CASE WHEN n - c - 1 > 0 AND n - 1 > 0 THEN (n - c - 1) / (n - 1) ELSE 1 END) END), 9) AS pass_at_k FROM per""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pass_at_k(_items(spark, d).where("template_id is not null"), "template_id", F.coalesce("correct", F.lit(False)), 2, "reference")


@query(
    "failure_views",
    f"""
    WITH {_PLANS}, f AS (
        SELECT plan_key, coalesce(success, false) AS ok, CASE WHEN coalesce(len(calls), 0) <= 1 THEN '0-1' WHEN len(calls) = 2 THEN '2' ELSE '3+' END AS depth,
            CAST(coalesce(len(list_distinct(list_transform(calls, lambda c: upper(trim(c.sub_id))))), 0) AS VARCHAR) AS subs,
            CASE WHEN coalesce(success, false) THEN 'correct' WHEN coalesce(len(calls), 0) = 0 THEN 'parse_failure' ELSE 'wrong_answer' END AS bin FROM plans)
    SELECT CASE WHEN depth IS NOT NULL THEN 'depth' WHEN subs IS NOT NULL THEN 'subs' WHEN bin IS NOT NULL THEN 'bin' ELSE 'all' END AS view, coalesce(depth, subs, bin, '') AS value,
        count(*) AS n, count(*) FILTER (WHERE ok) AS n_correct, min(plan_key) FILTER (WHERE NOT ok) AS example
    FROM f GROUP BY GROUPING SETS ((depth), (subs), (bin), ())
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0))
    p = _plans(spark, d).withColumns({"correct": F.col("success"), "n": n, "k": F.greatest(F.coalesce(F.size(F.array_distinct(F.transform("calls", lambda c: F.upper(F.trim(c["sub_id"]))))), F.lit(0)), F.lit(0))})
    error = F.when(F.col("n") == 0, "can't parse")
    return metrics.failures(p, F.col("n"), F.col("k"), metrics.failure_bin(error, F.col("n") > 0, F.col("correct")), "plan_key")


@query(
    "leakage_audit",
    f"""
    WITH i AS ({_ONE_ITEM}), r AS (SELECT item_id, exec_result AS g, list_transform(regexp_extract_all(array_to_string(list_transform(program.steps, lambda s: s.expr), ' '), '(^|[^A-Za-z0-9_.])([0-9]+(?:[.][0-9]+)?)', 2), lambda x: CAST(x AS DOUBLE)) AS cs,
        map_values(bindings) AS bs FROM i WHERE program IS NOT NULL AND exec_result IS NOT NULL)
    SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(list_concat(cs, coalesce(bs, [])), g)) AS n_leaking, CAST(coalesce(sum(len(cs)), 0) AS BIGINT) AS n_constants FROM r
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).where("program is not null and exec_result is not null")
    exprs = F.array_join(F.transform("program.steps", lambda s: s["expr"]), " ")
    found = F.transform(F.regexp_extract_all(exprs, F.lit(r"(^|[^A-Za-z0-9_.])([0-9]+(?:[.][0-9]+)?)"), F.lit(2)), lambda x: x.cast("double"))
    r = i.select("exec_result", found.alias("cs"), F.coalesce(F.map_values("bindings"), F.array().cast("array<double>")).alias("bs"))
    return r.agg(F.count("*").alias("n"), F.count_if(F.array_contains(F.concat("cs", "bs"), F.col("exec_result"))).alias("n_leaking"), F.coalesce(F.sum(F.size("cs")), F.lit(0)).alias("n_constants"))


@query(
    "rewards",
    f"""
    WITH i AS ({_ONE_ITEM}), r AS (SELECT program IS NOT NULL AS p, exec_result IS NOT NULL AS o, answer IS NOT NULL AS g, coalesce(correct, false) AS m FROM i)
    SELECT count(*) AS n, round(avg(CASE WHEN NOT p THEN 0 WHEN NOT o THEN 0.1 WHEN NOT g THEN 0.5 WHEN m THEN 1.0 ELSE 0.0 END), 6) AS composition, round(avg(CASE WHEN NOT p THEN 0 WHEN NOT o THEN 0.1 WHEN m THEN 1.0 ELSE 0.2 END), 6) AS flat FROM r
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p, o, g, m = F.col("program").isNotNull(), F.col("exec_result").isNotNull(), F.col("answer").isNotNull(), F.coalesce("correct", F.lit(False))
    return _items(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(search.composition_reward(p, o, g, m)), 6).alias("composition"), F.round(F.avg(search.flat_reward(p, o, m)), 6).alias("flat"))


@query(
    "rollout_rewards",
    f"""
    WITH i AS ({_ONE_ITEM}), r AS (SELECT item_id, exec_result AS x, coalesce(len(program.steps), 0) AS k FROM i)
    SELECT item_id, round(CASE WHEN x IS NULL THEN 0 ELSE 0.4 + 0.3 * least(k / 3, 1.0) + CASE WHEN x NOT IN (0, 1) THEN 0.2 ELSE 0 END + CASE WHEN abs(x) > 0.01 AND abs(x) < 1e8 THEN 0.1 ELSE 0 END END, 6) AS reward FROM r
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.greatest(F.coalesce(F.size("program.steps"), F.lit(0)), F.lit(0))
    return _items(spark, d).select("item_id", F.round(search.rollout_reward(F.col("exec_result"), k), 6).alias("reward"))


@query(
    "regression",
    """
    SELECT 'l_quantity' AS predictor, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson_r FROM lineitem
    UNION ALL SELECT 'l_discount', count(*), round(corr(l_discount, l_extendedprice), 6) FROM lineitem
    UNION ALL SELECT 'l_tax', count(*), round(corr(l_tax, l_extendedprice), 6) FROM lineitem
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("predictor", "n", "pearson_r")


@query("regression_full")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


# --- the memory simulation: events of a user, an action of three with its own cost --------------------------------

_ACTIONS = {"short": "u64", "middle": "u128", "long": "u256"}
_UTIL = """u AS (SELECT event_id, event_type || (user_id % 7) AS key, event_id % 5 = 0 AS is_test,
    CAST(value > 60 AS DOUBLE) - 0.15 * 64 / 256.0 AS u64, CAST(value > 30 AS DOUBLE) - 0.15 * 128 / 256.0 AS u128, CAST(value > 10 AS DOUBLE) - 0.15 * 256 / 256.0 AS u256 FROM events)"""


def _memory(spark: SparkSession, d: str) -> DataFrame:
    return memory_rows(table(spark, d, "events"))


def memory_rows(e: DataFrame) -> DataFrame:
    """Events as tasks of a memory: a key, whether they test it, and the utility of each action."""
    u = {c: metrics.utility(F.col("value") > v, F.lit(t)) for c, v, t in (("u64", 60, 64), ("u128", 30, 128), ("u256", 10, 256))}
    return e.select("event_id", F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("key"), (F.col("event_id") % 5 == 0).alias("is_test"), *(c.alias(n) for n, c in u.items()))


_BANK = f"""WITH {_UTIL}, g AS (SELECT key, count(*) AS n, round(avg(u64), 9) AS short, round(avg(u128), 9) AS middle, round(avg(u256), 9) AS long FROM u WHERE NOT is_test GROUP BY 1),
    b AS (SELECT key, n, greatest(short, middle, long) AS best, CASE greatest(short, middle, long) WHEN short THEN 'short' WHEN middle THEN 'middle' ELSE 'long' END AS action FROM g)"""


@query("pilot_bank", f"{_BANK} SELECT key, action, best, n FROM b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bank(_memory(spark, d).where("not is_test"), "key", _ACTIONS)


@query("pilot_static", f"{_BANK} SELECT count(*) AS n, round(avg(CASE coalesce(action, 'middle') WHEN 'short' THEN u64 WHEN 'middle' THEN u128 ELSE u256 END), 6) AS utility, round(avg(CAST(action IS NOT NULL AS DOUBLE)), 6) AS reuse FROM u LEFT JOIN b USING (key) WHERE is_test")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = _memory(spark, d)
    return metrics.static_memory(m.where("is_test"), metrics.bank(m.where("not is_test"), "key", _ACTIONS), "key", _ACTIONS, "middle")


@query("pilot_fixed", f"WITH {_UTIL} SELECT count(*) AS n, round(avg(u64), 6) AS short, round(avg(u128), 6) AS middle, round(avg(u256), 6) AS long FROM u WHERE is_test")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d).where("is_test").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(a) for a, c in _ACTIONS.items()))


@query(
    "pilot_dynamic",
    f"""
    WITH {_UTIL}, w AS (SELECT *, count(*) OVER x AS seen, round(avg(u64) OVER x, 9) AS a, round(avg(u128) OVER x, 9) AS b, round(avg(u256) OVER x, 9) AS c FROM u
        WINDOW x AS (PARTITION BY key ORDER BY CASE WHEN is_test THEN 1 ELSE 0 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT count(*) AS n, round(avg(CASE WHEN a IS NULL THEN u128 WHEN a = greatest(a, b, c) THEN u64 WHEN b = greatest(a, b, c) THEN u128 ELSE u256 END), 6) AS utility, round(avg(CAST(seen > 0 AS DOUBLE)), 6) AS reuse FROM w WHERE is_test
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dynamic_memory(_memory(spark, d), "key", "event_id", F.col("is_test"), _ACTIONS, "middle")


# --- search ------------------------------------------------------------------------------------------------------


@query(
    "slot_orders",
    f"""
    WITH i AS ({_ONE_ITEM}), n AS (SELECT item_id, len(regexp_extract_all(problem, '[0-9]+')) AS n, len(program.slots) AS k FROM i WHERE program IS NOT NULL AND problem IS NOT NULL),
    w AS (SELECT *, CAST(round(CASE k WHEN 1 THEN n WHEN 2 THEN n * (n - 1) WHEN 3 THEN n * (n - 1) * (n - 2) WHEN 4 THEN n * (n - 1) * (n - 2) * (n - 3) WHEN 5 THEN n * (n - 1) * (n - 2) * (n - 3) * (n - 4)
        WHEN 6 THEN n * (n - 1) * (n - 2) * (n - 3) * (n - 4) * (n - 5) END) AS BIGINT) AS ways FROM n WHERE k > 0 AND n >= k)
    SELECT item_id, CASE WHEN ways <= 2000 THEN ways ELSE 1 END AS n_orders FROM w
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).where("program is not null and problem is not null")
    v = i.select("item_id", F.regexp_extract_all("problem", F.lit("[0-9]+"), F.lit(0)).alias("v"), F.size("program.slots").alias("k"))
    return search.permutations(v, "item_id", "v", "k").groupBy("item_id").agg(F.count("*").alias("n_orders"))


@query("permutation_search")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first order of a problem's numbers with which its program gives the recorded result."""
    i = _items(spark, d).where("program is not null and problem is not null and exec_result is not null")
    v = i.select("item_id", "program", "exec_result", text.numbers(F.col("problem")).alias("v")).withColumn("k", F.size("program.slots"))
    orders = search.permutations(v, "item_id", "v", "k")
    tried = orders.join(v, "item_id").withColumn("vals", F.transform("order", lambda o: F.get("v", o)))
    bound = F.map_from_arrays(F.transform("program.slots", lambda s: s["name"]), "vals")
    tried = tried.select(F.struct("item_id", "rank").alias("key"), "program", "exec_result", bound.alias("bindings"))
    runs = executed(tried.withColumn("id", F.concat_ws("|", "key.item_id", "key.rank", F.col("exec_result").cast("string"))), "id").where("ok")
    parts = F.split("id", r"\|")
    r = runs.select(parts[0].cast("bigint").alias("item_id"), parts[1].cast("bigint").alias("rank"), F.abs(F.col("result") - parts[2].cast("double")).alias("gap"))
    return r.where("gap < 1e-6").groupBy("item_id").agg(F.min("rank").alias("rank"))


@query(
    "repair_neighbours",
    f"""
    WITH {_PLANS}, s AS (SELECT plan_key, list_transform(calls, lambda c: upper(trim(c.sub_id))) AS subs FROM plans WHERE len(calls) > 0),
    l AS (SELECT DISTINCT sub_id AS sub FROM sub_library WHERE sub_id IS NOT NULL), ids AS (SELECT list(sub) AS ids FROM l),
    e AS (SELECT plan_key, len(subs) AS k, len(ids) AS m, len(list_filter(subs, lambda x: list_contains(ids, x))) AS own, len(list_filter(subs, lambda x: x IS NULL)) AS none FROM s, ids),
    c AS (SELECT plan_key, generate_subscripts(calls, 1) AS pos, unnest(calls) AS c FROM plans),
    env AS (SELECT DISTINCT plan_key, b.key AS name FROM (SELECT plan_key, unnest(map_entries(c.bindings)) AS b FROM c) WHERE b.value.source IN ('quantity', 'constant') AND b.value.value IS NOT NULL),
    slots AS (SELECT plan_key, pos, sl.name AS slot FROM (SELECT plan_key, pos, unnest(l.program.slots) AS sl FROM c JOIN sub_library l ON upper(trim(l.sub_id)) = upper(trim(c.c.sub_id))))
    SELECT 'substitute' AS edit, CAST(sum((k - none) * m - own) AS BIGINT) AS n FROM e UNION ALL SELECT 'insert', CAST(sum(CASE WHEN k < 6 THEN (k + 1) * m ELSE 0 END) AS BIGINT) FROM e
    UNION ALL SELECT 'delete', CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) FROM e UNION ALL SELECT 'rebind', count(*) FROM slots JOIN env USING (plan_key) WHERE slot <> name
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.edit_counts(_plans(spark, d), table(spark, d, "sub_library"))


@query(
    "repair_rewards",
    f"{_RUN} SELECT id AS plan_key, round(0.25 * made + CASE WHEN n_calls > 0 AND made = n_calls THEN 0.1 ELSE 0 END - 0.05 * n_calls + CASE WHEN abs(result) > 1e-6 THEN 0.2 ELSE 0 END, 6) AS reward FROM done",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    r = execute.executed_plans(_plans(spark, d), _library(spark, d))
    return r.select("plan_key", F.round(search.repair_reward(F.col("calls_made"), F.col("n_calls"), F.lit(0), F.col("result")), 6).alias("reward"))


@query(
    "retrieval_topk",
    """
    WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM n),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_inner_product(q.v, c.v), 9) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 8
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.top_k(e.where("vec_id % 50 = 0"), e, 8).withColumn("score", F.round("score", 6))


@query("tree_search")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "heldout_items").select("item_id", text.numbers(F.col("problem")).alias("numbers"))
    return search.searched(h.repartition(8, "item_id"), _library(spark, d))


# --- sources and streams -----------------------------------------------------------------------------------------


@query("made_problems", "SELECT i, 'What is ' || ((7 * i + 3) % 100 + 1) || ' plus ' || ((11 * i + 5) % 100 + 1) || '?' AS problem, CAST((7 * i + 3) % 100 + 1 + (11 * i + 5) % 100 + 1 AS VARCHAR) AS answer FROM range(0, 2000) r(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.made_problems(spark, 2000)


@query("hash_sample", "SELECT item_id FROM heldout_items ORDER BY md5('42|' || item_id), item_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.hash_sample(table(spark, d, "heldout_items"), "item_id", 50).select("item_id")


@query(
    "split_semijoin",
    "SELECT DISTINCT template_id, name FROM templates WHERE template_id IN (SELECT template_id FROM eval_results WHERE lower(trim(split)) = 'train')",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "eval_results").where("lower(trim(split)) = 'train'")
    return files.in_split(table(spark, d, "templates"), "template_id", members, "template_id").select("template_id", "name").distinct()


@query(
    "event_windows",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    w = funnels.windowed_funnel(table(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


# --- growing a library, repair, controls -------------------------------------------------------------------------


@query(
    "varying_slots",
    f"WITH {_CALLS}, e AS (SELECT sub, unnest(map_entries(refs)) AS r FROM calls WHERE sub IS NOT NULL) SELECT sub, r.key AS slot, count(*) AS n, count(DISTINCT r.value.value) AS n_values, count(DISTINCT r.value.value) > 1 AS varies FROM e WHERE r.value.source IN ('quantity', 'constant') GROUP BY 1, 2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return evolve.varying_slots(_calls(spark, d))


@query(
    "shortest_correct",
    f"""
    WITH i AS ({_ONE_ITEM})
    SELECT template_id, item_id, n_steps FROM (SELECT template_id, item_id, len(program.steps) AS n_steps, row_number() OVER (PARTITION BY template_id ORDER BY len(program.steps), item_id) AS r
        FROM i WHERE correct AND len(program.steps) > 0 AND template_id IS NOT NULL) WHERE r = 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return evolve.shortest_correct(_items(spark, d), "template_id", "correct", "item_id")


@query(
    "rebuilt_choice",
    f"""
    WITH {_TYPED}, l AS (SELECT sub_id, {_OPS_SEQ.format('program.steps')} AS seq, len(program.steps) AS n FROM sub_library),
    s AS (SELECT seq, min(sub_id) AS same FROM l GROUP BY 1),
    c AS (SELECT p.row_id, s.same, (SELECT min(sub_id) FROM l WHERE l.n <= len(p.steps)) AS fits FROM p LEFT JOIN s ON s.seq = {_OPS_SEQ.format('p.steps')})
    SELECT row_id, coalesce(same, fits, (SELECT min(sub_id) FROM l)) AS sub_id, CAST(CASE WHEN same IS NOT NULL THEN 0 WHEN fits IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS tier FROM c
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return evolve.rebuilt_choice(_programs(spark, d), table(spark, d, "sub_library"))


@query(
    "window_controls",
    f"""
    WITH {_TYPED}, l AS (SELECT sub_id, len(program.steps) AS n_steps FROM sub_library WHERE program IS NOT NULL),
    b AS (SELECT n_steps, row_id, len(p.steps) AS n, row_number() OVER (PARTITION BY n_steps ORDER BY md5('42|' || n_steps || '|' || row_id)) AS r FROM (SELECT DISTINCT n_steps FROM l) k JOIN p ON len(p.steps) >= k.n_steps)
    SELECT sub_id, row_id, CAST(('0x' || md5('42|start|' || sub_id)[1:8]) AS BIGINT) % (n - n_steps + 1) AS start, CAST(n_steps AS BIGINT) AS n_steps FROM l JOIN b USING (n_steps) WHERE r = 1
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return evolve.windowed_entries(_programs(spark, d), _lengths(table(spark, d, "sub_library")))


@query("program_plans")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _programs(spark, d)
    prims = library.step_primitives(p).select("op", "canonical", "arity", F.concat(F.lit("P"), F.substring(F.md5(F.concat_ws("|", "op", "canonical")), 1, 6)).alias("prim"))
    return evolve.program_plans(p, prims)


def _lengths(entries: DataFrame) -> DataFrame:
    return entries.where("program is not null").select("sub_id", F.size("program.steps").alias("n_steps"))


@query(
    "combined_values",
    """
    WITH h AS (SELECT item_id, list_transform(regexp_extract_all(problem, '[0-9]+'), lambda x: CAST(x AS DOUBLE))[1:3] AS v FROM heldout_items WHERE len(regexp_extract_all(problem, '[0-9]+')) >= 2)
    SELECT item_id, 'sum' AS kind, list_sum(v) AS value FROM h UNION ALL SELECT item_id, 'product', list_product(v) FROM h UNION ALL SELECT item_id, 'difference', v[1] * 2 - list_sum(v) FROM h
    """,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform(F.regexp_extract_all("problem", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("double"))
    return evolve.combined_values(table(spark, d, "heldout_items").where("problem is not null").select("item_id", v.alias("v")), "item_id", "v")
