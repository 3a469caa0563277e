"""Evaluation: funnels, votes, pass@k, audits, failure bins, regression, and the memory simulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(n: Column, of: Column, digits: int = 4) -> Column:
    """n / of, rounded; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(n, of), F.lit(0.0)), digits)


def funnel(df: DataFrame, stages: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows that pass each stage and all before it, as counts and rates, in one aggregation (per group of ``by``)."""
    out, so_far = [F.count("*").alias("total")], F.lit(True)
    for name, cond in stages.items():
        so_far = so_far & F.coalesce(cond, F.lit(False))
        out += [F.count_if(so_far).alias(name), rate(F.count_if(so_far), F.count("*")).alias(f"{name}_rate")]
    return df.groupBy(*(by or [])).agg(*out)


def majority(df: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """(key, answer, votes): the most frequent non-null answer of each key, of equally frequent ones the first seen."""
    per = df.where(F.col(answer).isNotNull()).groupBy(key, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.groupBy(key).agg(F.max_by(answer, F.struct("n", -F.col("first"))).alias(answer), F.max("n").alias("votes"))


def pass_at_k(df: DataFrame, key: str, correct: Column, k: int, mode: str = "unbiased") -> DataFrame:
    """(n_keys, pass_at_k): the mean over keys of the chance that one of k samples is correct.

    'unbiased' is 1 - C(n-c, k) / C(n, k). 'reference' is 1 where c >= k, 0 where c = 0, else one minus the product of
    (n-c-i) / (n-i) over i < k without the factors that aren't positive.
    """
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(correct).alias("c"))
    each = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct((F.col("n") - F.col("c") - i).alias("a"), (F.col("n") - i).alias("b")))
    if mode == "reference":
        used = F.filter(each, lambda p: (p["a"] > 0) & (p["b"] > 0))
        special = F.when(F.col("c") == 0, 0.0).when(F.col("c") >= k, 1.0)
    else:
        used = each
        special = F.when(F.col("n") - F.col("c") < k, F.when(F.col("c") > 0, 1.0).otherwise(0.0))
    product = F.aggregate(used, F.lit(1.0), lambda s, p: s * p["a"] / p["b"])
    return per.select(special.otherwise(1 - product).alias("p")).agg(F.count("*").alias("n_keys"), F.round(F.avg("p"), 9).alias("pass_at_k"))


def failures(df: DataFrame, depth: Column, distinct: Column, bin_: Column, example: str) -> DataFrame:
    """(view, value, n, n_correct, example): failures by depth, by number of programs, by bin and overall, over one scan.

    ``df`` has correct. depth buckets are 0-1, 2 and 3+; example is the smallest failed key of the group.
    """
    bucket = F.when(depth <= 1, "0-1").when(depth == 2, "2").otherwise("3+")
    d = df.select(bucket.alias("depth"), distinct.cast("string").alias("subs"), bin_.alias("bin"), F.coalesce("correct", F.lit(False)).alias("ok"), F.col(example).alias("ex"))
    g = d.groupingSets([["depth"], ["subs"], ["bin"], []], "depth", "subs", "bin").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("ok").alias("n_correct"), F.min(F.when(~F.col("ok"), F.col("ex"))).alias("example")
    )
    view = F.when(F.col("g") == 3, "depth").when(F.col("g") == 5, "subs").when(F.col("g") == 6, "bin").otherwise("all")
    value = F.when(F.col("g") == 3, F.col("depth")).when(F.col("g") == 5, F.col("subs")).when(F.col("g") == 6, F.col("bin")).otherwise("")
    return g.select(view.alias("view"), F.coalesce(value, F.lit("")).alias("value"), "n", "n_correct", "example")


#: Bins of failures by what the error says, first match counts (fixed values: the bins' names).
ERROR_BINS = (
    ("parse_failure", r"json|parse|unterminated|expecting"),
    ("unknown_subroutine", r"unknown (?:program|sub)|no such sub|not in library"),
    ("missing_binding", r"missing (?:slot|binding)|unbound|candidates"),
    ("undefined_variable", r"is not defined|unknown name"),
    ("type_error", r"could not convert|invalid literal|type"),
    ("arithmetic_error", r"division|zero|overflow|domain"),
)


def failure_bin(error: Column, ok: Column, correct: Column) -> Column:
    """The bin of one result: by its error, else 'wrong_answer' if it ran, else 'other'; 'correct' if it is."""
    low = F.lower(F.coalesce(error, F.lit("")))
    out = F.when(F.coalesce(correct, F.lit(False)), "correct")
    for name, pattern in ERROR_BINS:
        out = out.when(low.rlike(pattern), name)
    return out.when(F.coalesce(ok, F.lit(False)), "wrong_answer").otherwise("other")


def compression(programs: DataFrame, cover: DataFrame, key: str = "row_id") -> DataFrame:
    """(n, mean_ratio, median_ratio, std_ratio): length of a covered program over its flat length.

    The flat length is the characters of all expressions and ten for each step; a covered step counts ten for its entry.
    The median is that of a sketch, within a ten-thousandth of its rank, so no task holds all values.
    """
    flat = F.aggregate(F.transform("steps", lambda s: F.length(F.coalesce(s["expr"], F.lit("")))), F.lit(0), lambda a, x: a + x) + 10 * F.size("steps")
    p = programs.where("steps is not null and size(steps) > 0").select(key, flat.alias("flat"))
    entries = F.when(F.col("cover") == "", 0).otherwise(F.size(F.split("cover", ">")))
    r = p.join(cover.select(key, (10 * entries).alias("entries"), "covered", "n_steps"), key)
    ratio = (F.col("entries") + F.col("flat") * (F.col("n_steps") - F.col("covered")) / F.greatest("n_steps", F.lit(1))) / F.col("flat")
    return r.select(ratio.alias("r")).agg(
        F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.round(F.percentile_approx("r", 0.5, 10_000), 6).alias("median_ratio"), F.round(F.stddev_pop("r"), 6).alias("std_ratio")
    )


def regression(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(predictor, beta, pearson_r, partial_r2, r2, adj_r2, n): least squares of standardised columns.

    One aggregation gives the sums of products; what the driver solves is as large as the number of predictors. Rows
    with a null are left out. A constant predictor has coefficient 0.
    """
    cols = [*xs, y]
    kept = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = kept.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), *(F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    n, k = row["n"], len(xs)
    m = np.array([row[f"s{i}"] or 0.0 for i in range(len(cols))]) / max(n, 1)
    c = np.zeros((len(cols), len(cols)))
    for i, (a, b) in enumerate(pairs):
        v = (row[f"p{i}"] or 0.0) / max(n, 1) - m[cols.index(a)] * m[cols.index(b)]
        c[cols.index(a), cols.index(b)] = c[cols.index(b), cols.index(a)] = v
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    ok = sd > 1e-12
    corr = np.where(np.outer(ok, ok), c / np.where(np.outer(ok, ok), np.outer(sd, sd), 1), 0.0)

    def fit(keep: list[int]) -> tuple[np.ndarray, float]:
        if not keep or not ok[-1]:
            return np.zeros(len(keep)), 0.0
        b = np.linalg.lstsq(corr[np.ix_(keep, keep)], corr[keep, -1], rcond=None)[0]
        return b, float(b @ corr[keep, -1])

    beta, r2 = fit(list(range(k)))
    adj = 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else r2
    rows = []
    for i, x in enumerate(xs):
        without = fit([j for j in range(k) if j != i])[1]
        rows.append((x, round(float(beta[i]), 6), round(float(corr[i, -1]), 6), round((r2 - without) / (1 - without) if without < 1 else 0.0, 6), round(r2, 6), round(adj, 6), int(n)))
    return df.sparkSession.createDataFrame(rows, "predictor string, beta double, pearson_r double, partial_r2 double, r2 double, adj_r2 double, n bigint")


def utility(correct: Column, tokens: Column, lam: float = 0.15) -> Column:
    """correct minus lam for each 256 tokens."""
    return correct.cast("double") - lam * tokens / 256.0


def bank(train: DataFrame, key: str, utilities: dict[str, str]) -> DataFrame:
    """(key, action, best, n): the action with the highest mean utility of each key, of equal ones the first."""
    g = train.groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 9).alias(a) for a, c in utilities.items()))
    top = F.greatest(*(F.col(a) for a in utilities))
    action = F.coalesce(*(F.when(F.col(a) == top, F.lit(a)) for a in utilities))
    return g.select(key, action.alias("action"), top.alias("best"), "n")


def static_memory(test: DataFrame, banked: DataFrame, key: str, utilities: dict[str, str], default: str) -> DataFrame:
    """(n, utility, reuse): test rows that take their key's action, or ``default`` where the key is unknown."""
    j = test.join(banked.select(key, "action"), key, "left")
    got = F.coalesce(*(F.when(F.coalesce("action", F.lit(default)) == a, F.col(c)) for a, c in utilities.items()))
    return j.agg(F.count("*").alias("n"), F.round(F.avg(got), 6).alias("utility"), F.round(F.avg(F.col("action").isNotNull().cast("double")), 6).alias("reuse"))


#: Span of the order in one part of a key's rows, in ``dynamic_memory``.
MEMORY_PART = 100_000


def dynamic_memory(rows: DataFrame, key: str, order: str, is_test: Column, utilities: dict[str, str], default: str, part: int = MEMORY_PART) -> DataFrame:
    """(n, utility, reuse): as ``static_memory``, but every test row also teaches the later ones of its key.

    Means before a row are running sums over its key, in two levels: within spans of ``part`` of the (numeric) order, and
    over the spans. So a key with very many rows is many small sorts, and the simulation is exact, as keys don't depend
    on each other.
    """
    cols = list(utilities.values())
    d = rows.withColumns({"_test": is_test, "_t": F.when(is_test, 1).otherwise(0), "_b": F.floor(F.col(order) / part)})
    w = Window.partitionBy(key, "_t", "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = d.withColumns({"_n": F.count(F.lit(1)).over(w), **{f"_s{i}": F.coalesce(F.sum(c).over(w), F.lit(0.0)) for i, c in enumerate(cols)}})
    spans = d.groupBy(key, "_t", "_b").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)))
    earlier = Window.partitionBy(key).orderBy("_t", "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select(
        F.col(key).alias("_k"), F.col("_t").alias("_t2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"), *(F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0.0)).alias(f"_z{i}") for i in range(len(cols)))
    )
    j = inner.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_t2")) & F.col("_b").eqNullSafe(F.col("_b2")))
    seen = F.col("_n") + F.col("_n0")
    j = j.withColumns({"_seen": seen, **{f"_m{i}": F.round(F.try_divide(F.col(f"_s{i}") + F.col(f"_z{i}"), seen), 9) for i in range(len(cols))}})
    top = F.greatest(*(F.col(f"_m{i}") for i in range(len(cols))))
    action = F.coalesce(*(F.when(F.col(f"_m{i}") == top, F.lit(a)) for i, a in enumerate(utilities)), F.lit(default))
    got = F.coalesce(*(F.when(action == a, F.col(c)) for a, c in utilities.items()))
    return j.where("_test").agg(F.count("*").alias("n"), F.round(F.avg(got), 6).alias("utility"), F.round(F.avg((F.col("_seen") > 0).cast("double")), 6).alias("reuse"))
