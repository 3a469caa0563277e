"""Audits of plans and programs: what runs, what matters, why it fails, what a library covers and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.text import normal_answer
from planloom.operators.metrics import rate
from planloom.plans.execute import consistency, executed_plans
from planloom.plans.programs import Program

_SUBS = "transform(calls, c -> upper(trim(c.sub_id)))"


def has_edge(calls: Column) -> Column:
    """Whether any binding of a plan refers to a call."""
    return F.coalesce(F.exists(calls, lambda c: F.exists(F.coalesce(F.map_values(c["bindings"]), F.array()), lambda r: r["source"] == "call_output")), F.lit(False))


def sensitivity(plans: DataFrame, library: dict[str, Program], share: float = 0.1) -> DataFrame:
    """(plan_key, n_bindings, n_active): of plans that run, their inline values and those that change the result by more than 1e-6 when ``share`` is added or taken away.

    A value of 0 can't be changed this way: it counts as a binding that isn't active. A changed plan that fails shows nothing.
    """
    base = executed_plans(plans, library, keep=("plan_key", "calls", "final")).where("ok").select("plan_key", "calls", "final", F.col("result").alias("_base"))
    refs = base.select("*", F.posexplode("calls").alias("at", "_c")).select("plan_key", "calls", "final", "_base", "at", F.explode("_c.bindings").alias("slot", "_ref"))
    inline = refs.where("_ref.source <> 'call_output' and _ref.value is not null")
    total = inline.groupBy("plan_key").agg(F.count("*").alias("n_bindings"))
    tried = inline.where("_ref.value <> 0").drop("_ref").withColumn("_f", F.explode(F.array(F.lit(1 + share), F.lit(1 - share))))
    new = "named_struct('source', r.source, 'value', r.value * _f, 'call_id', r.call_id, 'dtype', r.dtype, 'qid', CAST(NULL AS STRING), 'span', r.span, 'entity', r.entity, 'role', r.role)"
    swap = f"transform(calls, (c, i) -> if(i = at, named_struct('call_id', c.call_id, 'sub_id', c.sub_id, 'bindings', transform_values(c.bindings, (k, r) -> if(k = slot, {new}, r)), 'value_hint', c.value_hint), c))"
    again = executed_plans(tried.withColumn("calls", F.expr(swap)), library, keep=("plan_key", "at", "slot", "_base"))
    moved = again.groupBy("plan_key", "at", "slot").agg(F.bool_or(F.col("ok") & (F.abs(F.col("result") - F.col("_base")) > 1e-6)).alias("moved"))
    active = moved.groupBy("plan_key").agg(F.count_if("moved").alias("n_active"))
    return total.join(active, "plan_key", "left").select("plan_key", "n_bindings", F.coalesce("n_active", F.lit(0)).alias("n_active"))


def mechanism_rates(plans: DataFrame, library: dict[str, Program], by: str = "source") -> DataFrame:
    """Ten rates of a set of plans (plan_key, calls, final, success and ``by``) per group: what is present, runs, agrees and is right.

    Rates of agreement are over the plans whose hints could be compared, and null where there are none.
    """
    run = executed_plans(plans, library, keep=("plan_key", by, "calls", "success"))
    c = consistency(plans, library).select("plan_key", "n_hints", (F.col("n_consistent") + F.col("n_errors") > 0).alias("checked"), "agreement")
    j = run.join(c, "plan_key").withColumns({"edge": has_edge(F.col("calls")), "right": F.coalesce("success", F.lit(False))})
    n = F.count("*")
    share = lambda cond: rate(F.count_if(cond), n)
    checked = F.count_if("checked")
    agreed = F.round(F.try_divide(F.count_if(F.col("checked") & F.col("agreement")), F.when(checked > 0, checked)), 4)
    return j.groupBy(F.coalesce(by, F.lit("")).alias(by)).agg(
        n.alias("n"), share(F.col("n_calls") > 0).alias("parse_rate"), share(F.col("n_hints") > 0).alias("hint_rate"), share(F.col("edge")).alias("edge_rate"), share(F.col("ok")).alias("exec_rate"),
        agreed.alias("agreement_rate"), agreed.alias("consistency_rate"), share(F.col("ok") & F.col("right")).alias("symbolic_accuracy"), share(F.col("agreement") & F.col("right")).alias("hint_accuracy"),
        share(F.col("ok") & F.col("agreement") & F.col("right")).alias("gate_accuracy"), share(F.col("right")).alias("accuracy"),
    )


def faithful_audit(plans: DataFrame, library: dict[str, Program]) -> DataFrame:
    """One row: how many plans are built, run and are right, of those with flow between several or two calls, and how many calls they have."""
    run = executed_plans(plans, library, keep=("plan_key", "calls", "success")).withColumn("built", F.col("n_calls") > 0)
    right = F.col("ok") & F.coalesce("success", F.lit(False))
    multi = (F.col("n_calls") >= 2) & has_edge(F.col("calls"))
    two = (F.col("n_calls") == 2) & has_edge(F.col("calls"))
    hist = run.where("built").groupBy("n_calls").agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_calls", "n"))), lambda x: F.concat_ws(":", x["n_calls"], x["n"])), ",").alias("call_counts"))
    one = run.agg(
        F.count("*").alias("total"), F.count_if("built").alias("built"), F.count_if(multi).alias("multi_flow"), F.count_if(two).alias("two_flow"), F.count_if("ok").alias("executed"), F.count_if(right).alias("correct"),
        F.count_if(right & multi).alias("multi_correct"), F.count_if(right & two).alias("two_correct"), rate(F.count_if(right), F.count("*")).alias("coverage"), rate(F.count_if(right & multi), F.count_if(right)).alias("true_flow_rate"),
    )
    return one.crossJoin(F.broadcast(hist))  # one row each


def failure_steps(plans: DataFrame, library_df: DataFrame, library: dict[str, Program], keep: tuple[str, ...] = ()) -> DataFrame:
    """(plan_key, step, kind): the first call of a plan that gives no value, and why; step -1 where all do.

    'missing_sub': its program is unknown; 'type_mismatch': a slot has no value; 'execution_error': it has all and fails;
    'no_plan': there are no calls; 'wrong_answer': every call gives a value, so at most the result is wrong.
    """
    done = executed_plans(plans, library, keep=("plan_key", "calls", *keep))
    first = F.expr("array_position(transform(outputs, o -> o.value IS NULL), true)")
    d = done.withColumn("_i", F.coalesce(first, F.lit(0)).cast("int")).withColumn("_c", F.expr("if(_i > 0, calls[_i - 1], NULL)"))
    lib = library_df.where("sub_id is not null and program is not null").select(F.upper(F.trim("sub_id")).alias("_sub"), F.transform("program.slots", lambda s: s["name"]).alias("_need"))
    j = d.withColumn("_sub", F.upper(F.trim("_c.sub_id"))).join(lib, "_sub", "left")
    r = "try_element_at(_c.bindings, n)"
    empty = F.expr(f"exists(_need, n -> {r} IS NULL OR if({r}.source = 'call_output', size(filter(slice(outputs, 1, _i - 1), o -> o.call_id = {r}.call_id)) = 0, {r}.value IS NULL))")
    kind = (
        F.when(F.col("n_calls") == 0, "no_plan").when(F.col("_i") == 0, "wrong_answer").when(F.col("_need").isNull(), "missing_sub").when(F.coalesce(empty, F.lit(True)), "type_mismatch").otherwise("execution_error")
    )
    return j.select("plan_key", *keep, (F.col("_i") - 1).cast("bigint").alias("step"), kind.alias("kind"), "calls")


#: What an error says where the language lacks something (fixed values).
LANGUAGE_LIMITS = ("complex", "imaginary", "is not defined", "unsupported operand", "division by zero", "math domain error", "overflow")
#: What it says where a search found nothing (fixed values).
SEARCH_FAILURES = ("search_failed", "no solution found", "mcts", "simulations", "max_simulations", "solutions_found.*0", "timeout")


def failure_class(error: Column, method: Column, predicted: Column, gold: Column, has_plan: Column, n_subs: Column, n_unknown: Column, n_common: Column) -> Column:
    """The class of a failure, by the first rule that holds; nulls hold in none.

    n_subs, n_unknown, n_common: programs that the plan calls, those unknown to the library, and those that are used
    often and gain little.
    """
    low = F.lower(F.coalesce(error, F.lit("")))
    p, g = normal_answer(predicted), normal_answer(gold)
    pn, gn = p.try_cast("double"), g.try_cast("double")
    gap = F.abs(pn - gn)
    whole = (pn == F.floor(pn)) & (gn == F.floor(gn)) & (pn != gn)
    close = (gap < F.greatest(F.abs(gn) * 0.02, F.lit(1.0))) & (gap >= 1e-3)
    numbers = pn.isNotNull() & gn.isNotNull()
    extraction = F.when(numbers, close | (~whole & (p != g) & (gap < 1e-3))).otherwise((p != g) & (F.contains(p, g) | F.contains(g, p)))
    step = low.rlike(r"step \d+ \([^)]*\):")
    any_of = lambda words: low.rlike("|".join(words))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(method.isin("mcts", "search", "mcts_compose") & any_of(SEARCH_FAILURES)), "search_failed")
        .when(yes(extraction), "answer_extraction")
        .when(~yes(has_plan) | low.contains("unknown subroutine '"), "missing_abstraction")
        .when(yes(any_of(LANGUAGE_LIMITS)), "dsl_limitation")
        .when(low.rlike("cannot bind slot '|missing binding for slot '|cannot coerce"), "wrong_bindings")
        .when((n_subs > 0) & (n_unknown > 0), "missing_abstraction")
        .when((n_common > 0) & (n_common >= n_subs / 2), "spurious_subroutine")
        .when((n_subs >= 2) & step, "wrong_order")
        .when((n_subs > 0) & low.contains("execution failed"), "wrong_abstraction")
        .when(step, "dsl_limitation")
        .when(low.rlike("max (?:steps|calls) exceeded"), "wrong_order")
        .when(n_subs > 0, "wrong_abstraction")
        .otherwise("missing_abstraction")
    )


def failure_classes(plans: DataFrame, library_df: DataFrame, library: dict[str, Program]) -> DataFrame:
    """(plan_key, class): plans without success, with the class of their failure, judged by where they stop and by the library's upper medians of support and gain."""
    steps = failure_steps(plans, library_df, library, keep=("success",)).where("not coalesce(success, false)")
    lib = library_df.where("sub_id is not null").select(F.upper(F.trim("sub_id")).alias("sub"), F.coalesce("support", F.lit(0)).alias("s"), F.coalesce("mdl_gain", F.lit(0.0)).alias("g"))
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    m = lib.agg(upper("s").alias("ms"), upper("g").alias("mg"))  # of a library, whose size is checked where it is read
    common = lib.crossJoin(F.broadcast(m)).select("sub", ((F.col("s") >= F.col("ms")) & (F.col("g") <= F.col("mg"))).alias("common"))
    subs = steps.select("plan_key", F.explode(F.expr(_SUBS)).alias("sub")).where("sub is not null").join(common, "sub", "left")
    counts = subs.groupBy("plan_key").agg(F.count("*").alias("n_subs"), F.count_if(F.col("common").isNull()).alias("n_unknown"), F.count_if("common").alias("n_common"))
    j = steps.join(counts, "plan_key", "left").fillna(0, ["n_subs", "n_unknown", "n_common"])
    says = F.when(F.col("kind") == "missing_sub", "Unknown subroutine 'x'").when(F.col("kind") == "type_mismatch", "Missing binding for slot 'x'").when(F.col("kind") == "execution_error", "Step 0 (res): division by zero")
    none = F.lit(None).cast("string")
    return j.select("plan_key", failure_class(says, none, none, none, F.col("kind") != "no_plan", F.col("n_subs"), F.col("n_unknown"), F.col("n_common")).alias("class"))


def first_plans(programs: DataFrame, plans: DataFrame, key: str, program_key: str = "row_id") -> DataFrame:
    """(program_key, source, flat_length, length, ratio): what a program costs flat and by the first plan of the same ``key``, where there is one.

    Flat: the characters of its expressions and ten a step. By a plan: the characters of the programs' ids, of the slots
    that are bound, and ten for each of these. Ratio: flat over the other; 1 without a plan.
    """
    flat = F.aggregate(F.transform("steps", lambda s: F.length(F.coalesce(s["expr"], F.lit("")))), F.lit(0), lambda a, x: a + x) + 10 * F.size("steps")
    slots = "aggregate(coalesce(map_keys(c.bindings), array()), 0, (a, k) -> a + length(k) + 10)"
    cost = F.expr(f"aggregate(calls, 0, (a, c) -> a + length(coalesce(c.sub_id, '')) + {slots})")
    first = plans.where(F.col(key).isNotNull() & (F.size("calls") > 0)).groupBy(key).agg(F.min_by(F.struct(cost.alias("cost")), "plan_key").alias("p"))
    j = programs.where("size(steps) > 0").select(program_key, "source", key, flat.alias("flat_length")).join(first, key, "left")
    length = F.greatest(F.coalesce("p.cost", "flat_length"), F.lit(1))
    return j.select(program_key, "source", F.col("flat_length").cast("bigint").alias("flat_length"), length.cast("bigint").alias("length"), F.round(F.col("flat_length") / length, 6).alias("ratio"))


def template_coverage(problems: DataFrame, templates: DataFrame, key: str, text: str) -> DataFrame:
    """(key, template_id, score): the template that fits a problem best; problems that none fits are left out.

    Each step whose operation's words are in the text scores 1 a word, a domain in the text 2; of equal ones the most
    used, then the first. What a text has of the templates' words and domains decides, so texts are compared with words,
    not with templates, and templates with the distinct sets of words only: their number is bounded by the vocabulary.
    """
    t = templates.where("template_id is not null")
    words = t.select("template_id", F.explode("steps").alias("s")).select("template_id", F.explode(F.regexp_extract_all(F.lower("s.operation"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    worth = words.groupBy("template_id", "word").agg(F.count("*").alias("n")).unionByName(t.where("domain is not null").select("template_id", F.col("domain").alias("word"), F.lit(2).cast("bigint").alias("n")))
    vocabulary = sorted(r.word for r in worth.select("word").distinct().limit(10_001).collect())
    if len(vocabulary) > 10_000:
        raise ValueError("more than 10,000 words in operations and domains")
    has = F.filter(F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>"), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))
    p = problems.select(key, has.alias("has")).where(F.size("has") > 0)
    sets = p.select("has").distinct()
    scored = sets.select("has", F.explode("has").alias("word")).join(worth, "word").groupBy("has", "template_id").agg(F.sum("n").alias("score"))
    ranked = scored.join(t.select("template_id", F.coalesce("reuse_count", F.lit(0)).alias("reuse")), "template_id")
    best = ranked.groupBy("has").agg(F.max("score").alias("score"), F.min_by("template_id", F.struct(-F.col("score"), -F.col("reuse"), "template_id")).alias("template_id"))
    return p.join(best, "has").select(key, "template_id", "score")


def op_library(programs: DataFrame, size: int = 16, min_support: int = 2, key: str = "row_id") -> DataFrame:
    """(sub_id, ops, support, first_id): the most frequent sequences of operations as a library."""
    ops = F.array_join(F.transform("steps", lambda s: F.lower(s["op"])), ",")
    g = programs.where("size(steps) > 0").groupBy(ops.alias("ops")).agg(F.count("*").alias("support"), F.min(key).alias("first_id")).where(F.col("support") >= min_support)
    top = g.orderBy(F.desc("support"), "first_id").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("support"), "first_id")) - 1  # at most ``size`` rows
    return top.select(F.concat(F.lit("L"), F.lpad(rank.cast("string"), 2, "0")).alias("sub_id"), "ops", "support", "first_id")
