"""Algebra of text templates: steps with ``{name}`` placeholders, variables with types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.text import filled
from planloom.plans.programs import fingerprint


def template_fingerprint(steps: Column) -> Column:
    return fingerprint(steps, "operation", "expression")


def bank(templates: DataFrame) -> DataFrame:
    """(fingerprint, first_id, reuse, n_sources, sources): templates without repeats, with the uses of all copies and their ids in order."""
    t = templates.where("steps is not null").select(template_fingerprint(F.col("steps")).alias("fingerprint"), "template_id", F.coalesce("reuse_count", F.lit(0)).alias("reuse_count"))
    return t.groupBy("fingerprint").agg(F.min("template_id").alias("first_id"), F.sum("reuse_count").alias("reuse"), F.count("*").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("template_id")), ",").alias("sources"))


def bank_stats(templates: DataFrame) -> DataFrame:
    """(domain, n, avg_steps, avg_variables, total_reuse) by domain; a null domain is ''."""
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return templates.groupBy(F.coalesce("domain", F.lit("")).alias("domain")).agg(
        F.count("*").alias("n"), F.round(F.avg(size("steps")), 6).alias("avg_steps"), F.round(F.avg(size("variables")), 6).alias("avg_variables"),
        F.coalesce(F.sum("reuse_count"), F.lit(0)).alias("total_reuse"),
    )


def search(templates: DataFrame, domain: str, min_reuse: int) -> DataFrame:
    """Templates of a domain with enough uses, the most used first."""
    return templates.where((F.col("domain") == domain) & (F.col("reuse_count") >= min_reuse)).orderBy(F.desc("reuse_count"), "template_id")


def instantiate(templates: DataFrame, bindings: Column) -> DataFrame:
    """(template_id, step_id, operation, expression): steps with the values of MAP<STRING, STRING> ``bindings`` filled in."""
    s = templates.select("template_id", bindings.alias("b"), F.explode("steps").alias("s"))
    return s.select("template_id", F.col("s.step_id").cast("bigint").alias("step_id"), "s.operation", filled(F.col("s.expression"), F.col("b")).alias("expression"))


def specialize(templates: DataFrame, name: Column, value: Column) -> DataFrame:
    """(template_id, variables, expressions): one variable bound in all steps and dropped from the variables."""
    t = templates.withColumns({"_n": name, "_v": value}).where("_n is not null")
    left = F.array_join(F.transform(F.filter("variables", lambda v: v["name"] != F.col("_n")), lambda v: v["name"]), ",")
    bound = F.array_join(F.transform("steps", lambda s: F.replace(s["expression"], F.concat(F.lit("{"), F.col("_n"), F.lit("}")), F.col("_v"))), ";")
    return t.select("template_id", left.alias("variables"), bound.alias("expressions"))


def decompose(templates: DataFrame) -> DataFrame:
    """(template_id, step_id, operation, variables): one template per step, with the variables that it mentions."""
    t = templates.select("template_id", "variables", F.explode("steps").alias("s"))
    used = F.filter("variables", lambda v: F.contains(F.col("s.expression"), F.concat(F.lit("{"), v["name"], F.lit("}"))))
    return t.select("template_id", F.col("s.step_id").cast("bigint").alias("step_id"), "s.operation", F.array_join(F.transform(used, lambda v: v["name"]), ",").alias("variables"))


def composed(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """(id_a, id_b, variables, v_a, steps): two templates one after the other, variables by name and steps by expression.

    Variables that the first one's steps make are dropped from the second's. Pairs are those with the same ``on``; the
    caller bounds how many there are of one. Null lists are as empty ones.
    """
    listed = lambda c, field: F.coalesce(F.transform(c, lambda x: x[field]), F.array().cast("array<string>"))
    side = lambda df, x: df.select(
        F.col(on), F.col("template_id").alias(f"id_{x}"), listed("variables", "name").alias(f"v_{x}"), listed("steps", "expression").alias(f"e_{x}"), listed("steps", "output_var").alias(f"made_{x}")
    )
    j = side(first, "a").join(side(second, "b"), on)
    rest = F.filter("v_b", lambda v: ~F.array_contains("made_a", v))
    return j.select("id_a", "id_b", F.array_distinct(F.concat("v_a", rest)).alias("variables"), "v_a", F.concat("e_a", "e_b").alias("steps"))


def _unmade(names: Column, made: Column) -> Column:
    return F.filter(names, lambda v: ~F.array_contains(made, v))


def chains(templates: DataFrame, by: str = "domain", lengths: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """(chain, length, n_steps, variables): every so many templates that follow each other by id within a group, composed.

    variables are those that no earlier template of the chain makes, by name, in order. Null lists are as empty ones.
    """
    w = Window.partitionBy(by).orderBy("template_id")
    listed = lambda c, field: F.coalesce(F.transform(c, lambda x: x[field]), F.array().cast("array<string>"))
    t = templates.where(F.col(by).isNotNull()).select(by, "template_id", listed("variables", "name").alias("v"), listed("steps", "output_var").alias("made"), F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0)).alias("n"))
    ahead = t.select(*(F.lead(c, i).over(w).alias(f"{c}{i}") for c in ("template_id", "v", "made", "n") for i in range(max(lengths))))
    out = None
    for k in lengths:
        free, made = F.col("v0"), F.col("made0")
        for i in range(1, k):
            free = F.concat(free, _unmade(F.col(f"v{i}"), made))
            made = F.concat(made, f"made{i}")
        row = ahead.where(f"template_id{k - 1} is not null").select(
            F.concat_ws(">", *(f"template_id{i}" for i in range(k))).alias("chain"), F.lit(k).cast("bigint").alias("length"),
            sum((F.col(f"n{i}") for i in range(k)), F.lit(0)).cast("bigint").alias("n_steps"), F.array_join(F.array_distinct(free), ",").alias("variables"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def merge(templates: DataFrame, by: str = "domain") -> DataFrame:
    """(group, variables, steps): templates of a group as one: its variables by name and its steps without repeats, sorted; what a group holds is bounded by its distinct names and steps."""
    g = F.coalesce(by, F.lit("")).alias("grp")
    v = templates.select(g, F.explode("variables").alias("v")).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("v.name")), ",").alias("variables"))
    s = templates.select(g, F.explode("steps").alias("s")).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set(F.concat("s.operation", F.lit(":"), "s.expression"))), ";").alias("steps"))
    return v.join(s, "grp")


def shared_variables(templates: DataFrame, by: str = "domain") -> DataFrame:
    """(id_a, id_b, shared): the variables that a template shares with the next one of its group, in its own order."""
    w = Window.partitionBy(by).orderBy("template_id")
    names = F.coalesce(F.transform("variables", lambda v: v["name"]), F.array().cast("array<string>"))
    t = templates.where(F.col(by).isNotNull()).select(by, "template_id", names.alias("v"))
    j = t.select(F.col("template_id").alias("id_a"), "v", F.lead("template_id").over(w).alias("id_b"), F.lead("v").over(w).alias("v2"))
    return j.where("id_b is not null").select("id_a", "id_b", F.array_join(F.array_intersect("v", "v2"), ",").alias("shared"))


def abstract(templates: DataFrame) -> DataFrame:
    """(template_id, expressions, n_new): every number in a template's expressions as a new variable c0, c1, ... of its own.

    Numbers are whole tokens: digits inside a name or another number are left alone.
    """
    joined = F.array_join(F.transform("steps", lambda s: s["expression"]), " ; ")
    found = F.regexp_extract_all(joined, F.lit(r"(?<![\w.{])\d+(?:\.\d+)?(?![\w.}])"), F.lit(0))
    parts = F.split(joined, r"(?<![\w.{])\d+(?:\.\d+)?(?![\w.}])")
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(found), F.concat(p, F.lit("{c"), i.cast("string"), F.lit("}"))).otherwise(p)), "")
    return templates.where("steps is not null").select("template_id", text.alias("expressions"), F.size(found).cast("bigint").alias("n_new"))


def keyword_index(templates: DataFrame, top: int = 20) -> DataFrame:
    """(word, n_templates, first_id): words of more than three letters in names, and domains, with their templates; the most frequent."""
    words = F.array_distinct(F.concat(F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit(r"[a-z]{4,}"), F.lit(0)), F.array_compact(F.array(F.lower("domain")))))
    return templates.select("template_id", F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n_templates"), F.min("template_id").alias("first_id")).orderBy(F.desc("n_templates"), "word").limit(top)
