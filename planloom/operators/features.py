"""Features of plans: calls in order, atoms, compounds, data flow; distances between splits, and the constrained split.

A plan's calls are exploded once into rows (plan_key, pos, sub, keys); neighbours are windows over a plan, which is small.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.session import cut


def _in_plan():
    return Window.partitionBy("plan_key").orderBy("pos")


def plan_calls(plans: DataFrame) -> DataFrame:
    """(plan_key, pos, call_id, sub, keys, refs): calls of plans, deliveries once; sub in upper case, slots sorted."""
    once = plans.where("plan_key is not null").groupBy("plan_key").agg(F.first("calls").alias("calls"))
    c = once.select("plan_key", F.posexplode("calls").alias("pos", "c"))
    keys = F.coalesce(F.array_sort(F.map_keys("c.bindings")), F.array().cast("array<string>"))
    return c.select("plan_key", F.col("pos").cast("bigint").alias("pos"), "c.call_id", F.upper(F.trim("c.sub_id")).alias("sub"), keys.alias("keys"), F.col("c.bindings").alias("refs"))


def bigrams(calls: DataFrame, n: int = 2) -> DataFrame:
    """(plan_key, pos, gram): ``n`` adjacent programs, joined by '>'."""
    cols = [F.col("sub"), *(F.lead("sub", i).over(_in_plan()) for i in range(1, n))]
    whole = F.lead("pos", n - 1).over(_in_plan())
    return calls.select("plan_key", "pos", F.concat_ws(">", *cols).alias("gram"), whole.alias("_w")).where("_w is not null").drop("_w")


def atoms(calls: DataFrame) -> DataFrame:
    """(plan_key, atom, n): programs, arities, kinds of values and number of calls of each plan, counted."""
    kinds = calls.select("plan_key", F.explode_outer(F.map_values("refs")).alias("r")).where("r is not null").select("plan_key", F.concat(F.lit("type:"), F.coalesce("r.dtype", F.lit("float"))).alias("atom"))
    each = [
        calls.select("plan_key", F.concat(F.lit("sub:"), "sub").alias("atom")),
        calls.select("plan_key", F.concat(F.lit("arity:"), F.size("keys").cast("string")).alias("atom")),
        kinds,
        calls.groupBy("plan_key").agg(F.concat(F.lit("num_calls:"), F.count("*").cast("string")).alias("atom")),
    ]
    return reduce(DataFrame.unionByName, each).where("atom is not null").groupBy("plan_key", "atom").agg(F.count("*").alias("n"))


def depths(calls: DataFrame) -> DataFrame:
    """``calls`` with depth: how many slots were seen in earlier calls and aren't in this one, at most 3."""
    before = F.flatten(F.collect_list("keys").over(_in_plan().rowsBetween(Window.unboundedPreceding, -1)))
    return calls.withColumn("depth", F.least(F.size(F.array_except(F.array_distinct(before), "keys")), F.lit(3)).cast("bigint"))


def compounds(calls: DataFrame) -> DataFrame:
    """(plan_key, compound), distinct: neighbours, slots, flows, shared slots, depths, arities and length of each plan.

    One sort of the calls by plan serves all of them: each call gives an array of its compounds, with what comes after it
    in its plan, and the repeats of a plan are dropped where it is.
    """
    after = _in_plan().rowsBetween(1, Window.unboundedFollowing)
    d = depths(calls).withColumn("_later", F.collect_list(F.struct("sub", "keys")).over(after))
    nxt = lambda c, i=1: F.lead(c, i).over(_in_plan())
    d = d.withColumns({"s1": nxt("sub"), "s2": nxt("sub", 2), "a1": nxt(F.size("keys")), "d1": nxt("depth"), "d2": nxt("depth", 2), "_total": F.when(F.lead("pos").over(_in_plan()).isNull(), F.count("*").over(_in_plan()))})
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    s = lambda c: F.col(c).cast("string")
    single = F.array(
        cat("bigram:", s("sub"), ">", s("s1")),
        cat("trigram:", s("sub"), ">", s("s1"), ">", s("s2")),
        cat("flow:", s("sub"), "->", s("s1")),
        cat("pos:", s("pos"), ":", s("sub")),
        cat("arity_pair:", F.size("keys").cast("string"), ">", s("a1")),
        cat("depth_trigram:", s("depth"), ">", s("d1"), ">", s("d2")),
        cat("type_sig:", s("sub"), "(", F.array_join(F.array_sort(F.transform(F.map_values("refs"), lambda r: F.coalesce(r["dtype"], F.lit("float")))), ","), ")"),
        cat("total_calls:", s("_total")),
    )
    bind = F.transform("keys", lambda k: cat("bind:", s("sub"), ".", k))
    bind_flow = F.flatten(F.transform("_later", lambda c: F.transform(F.array_intersect("keys", c["keys"]), lambda k: cat("bind_flow:", s("sub"), ">", c["sub"], ":", k))))
    every = F.explode(F.array_distinct(F.array_compact(F.concat(single, bind, bind_flow)))).alias("compound")
    return d.select("plan_key", every).distinct()


def shared_slots(calls: DataFrame) -> DataFrame:
    """(plan_key, slot, a, b, pos_a, pos_b): every two calls of a plan, the first earlier, that bind a slot of one name."""
    k = calls.select("plan_key", "pos", "sub", F.explode("keys").alias("slot"))
    a = k.select("plan_key", "slot", F.col("pos").alias("pos_a"), F.col("sub").alias("a"))
    b = k.select("plan_key", "slot", F.col("pos").alias("pos_b"), F.col("sub").alias("b"))
    return a.join(b, ["plan_key", "slot"]).where("pos_a < pos_b")


def flow_edges(calls: DataFrame) -> DataFrame:
    """(plan_key, src_call, dst_call, slot, pos): every reference to a call's output, repeated ones too."""
    r = calls.select("plan_key", "pos", F.col("call_id").alias("dst_call"), F.explode("refs").alias("slot", "r")).where("r.source = 'call_output'")
    return r.select("plan_key", F.col("r.call_id").alias("src_call"), "dst_call", "slot", "pos")


def true_flow(calls: DataFrame) -> DataFrame:
    """(plan_key, compound), distinct, from explicit references only: programs, flows between them, by slot, several calls."""
    e = flow_edges(calls)
    src = calls.where("call_id is not null").groupBy("plan_key", F.col("call_id").alias("src_call")).agg(F.max_by("sub", "pos").alias("src_sub"))
    dst = calls.select("plan_key", "pos", F.col("sub").alias("dst_sub"))
    j = e.join(src, ["plan_key", "src_call"], "left").join(dst, ["plan_key", "pos"])
    a, b = F.coalesce("src_sub", F.lit("?")), F.coalesce("dst_sub", F.lit("?"))
    n = calls.groupBy("plan_key").agg(F.count("*").alias("n")).where("n > 1")
    parts = [
        calls.where("sub is not null").select("plan_key", F.concat(F.lit("sub:"), "sub").alias("compound")),
        j.select("plan_key", F.concat(F.lit("true_flow:"), a, F.lit(">"), b).alias("compound")),
        j.select("plan_key", F.concat(F.lit("flow_slot:"), a, F.lit(">"), b, F.lit("."), "slot").alias("compound")),
        n.select("plan_key", F.concat(F.lit("multicall:"), F.col("n").cast("string")).alias("compound")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def tvd(counts: DataFrame, side: Column, feature: str = "atom", n: str = "n") -> DataFrame:
    """(tvd): half the sum of |p - q| over features; 1 if a side is empty. ``side`` is true for the first side; a single pass."""
    per = counts.groupBy(feature).agg(F.sum(F.when(side, F.col(n)).otherwise(0)).alias("p"), F.sum(F.when(~side, F.col(n)).otherwise(0)).alias("q"))
    total = per.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    if not total.p or not total.q:
        return per.agg(F.lit(1.0).alias("tvd"))
    return per.agg(F.round(0.5 * F.sum(F.abs(F.col("p") / float(total.p) - F.col("q") / float(total.q))), 9).alias("tvd"))


def divergence(features: DataFrame, train: Column, test: Column, feature: str = "compound") -> DataFrame:
    """(n_test, n_unseen, divergence): distinct features of the test side, and those of them unseen in training."""
    per = features.groupBy(feature).agg(F.max(train).alias("tr"), F.max(test).alias("te")).where("te")
    n, unseen = F.count("*"), F.count_if(~F.col("tr"))
    return per.agg(n.alias("n_test"), unseen.alias("n_unseen"), F.round(F.coalesce(F.try_divide(unseen, n), F.lit(0.0)), 9).alias("divergence"))


#: Trials of a constrained split (fixed value).
TRIALS = 500


def _split(seed: int, trial: Column, shares: tuple[float, float]) -> Column:
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), trial.cast("string"), F.col("plan_key").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "dev").otherwise("test")


def assignments(keys: DataFrame, trials: int, seed: int = 42, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """(trial, plan_key, split): for each trial every plan in train, dev or test, by its place in the order of a hash.

    The place is approximated by the hash itself, uniform in [0, 1): no trial is sorted, and any share of plans lands
    in a split as exactly as the number of plans allows.
    """
    t = keys.select("plan_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint"))).alias("trial"))
    return t.withColumn("split", _split(seed, F.col("trial"), shares))


def _masks(keys: DataFrame, trials: int, seed: int, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """(plan_key, tr0, te0, tr1, te1, ...): the ``assignments`` of a plan as bits, 64 trials to a number, the first lowest."""
    n = -(-trials // 64)
    heads = [f"{seed}|{t}|".encode() for t in range(trials)]
    # places below these are train, and train or dev
    low, high = (math.ceil(x * 2**32) for x in (shares[0], shares[0] + shares[1]))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            bits = np.zeros((2, len(b), n * 64), np.uint8)
            for i, key in enumerate(b["plan_key"]):
                tail = str(key).encode()
                u = np.frombuffer(b"".join(hashlib.md5(h + tail).digest()[:4] for h in heads), ">u4")
                bits[0, i, :trials], bits[1, i, :trials] = u < low, u >= high
            tr, te = np.packbits(bits, axis=2, bitorder="little").view("<i8")
            yield pd.DataFrame({"plan_key": b["plan_key"]} | {f"{s}{i}": m[:, i] for i in range(n) for s, m in (("tr", tr), ("te", te))})

    return keys.select("plan_key").mapInPandas(batches, "plan_key bigint, " + ", ".join(f"tr{i} bigint, te{i} bigint" for i in range(n)))


def _bits(b: pd.DataFrame, side: str, trials: int) -> np.ndarray:
    m = np.stack([b[f"{side}{i}"].to_numpy("<i8") for i in range(-(-trials // 64))], axis=1)
    return np.unpackbits(np.ascontiguousarray(m).view(np.uint8), axis=1, bitorder="little")[:, :trials]


def trial_scores(calls: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """(trial, tvd, divergence) of random splits: atoms of train and test alike, compounds of test unseen in train.

    The trials of a plan are bits of a few numbers, so no row is repeated for a trial: a compound's trials are the bits
    of its plans put together, an atom's counts are added for all trials at once in each task.
    """
    masks = cut(_masks(calls.select("plan_key").distinct(), trials, seed))
    sides = [c for c in masks.columns if c != "plan_key"]

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in it:
            for at in range(0, len(b), 4096):
                part = b[at : at + 4096].sort_values("atom", kind="stable")
                names, starts = np.unique(part["atom"].to_numpy(str), return_index=True)
                n = part["n"].to_numpy(np.int64)[:, None]
                both = [np.add.reduceat(_bits(part, side, trials) * n, starts, axis=0) for side in ("tr", "te")]
                for name, p, q in zip(names, *both):
                    sums[name] = sums.get(name, 0) + np.stack([p, q])
        yield pd.DataFrame([(k, v[0], v[1]) for k, v in sums.items()], columns=["atom", "ps", "qs"])

    def unseen(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        te, new = np.zeros(trials, np.int64), np.zeros(trials, np.int64)
        for b in it:
            for at in range(0, len(b), 4096):
                tr_, te_ = (_bits(b[at : at + 4096], side, trials) for side in ("tr", "te"))
                te, new = te + te_.sum(axis=0, dtype=np.int64), new + (te_ & (1 - tr_)).sum(axis=0, dtype=np.int64)
        yield pd.DataFrame({"trial": np.arange(trials), "te": te, "new": new})

    by_task = atoms(calls).join(masks, "plan_key").mapInPandas(counted, "atom string, ps array<bigint>, qs array<bigint>")
    each = by_task.select("atom", F.posexplode(F.arrays_zip("ps", "qs")).alias("trial", "c"))
    a = cut(each.groupBy(F.col("trial").cast("bigint").alias("trial"), "atom").agg(F.sum("c.ps").alias("p"), F.sum("c.qs").alias("q")))
    totals = a.groupBy("trial").agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    t = a.join(totals, "trial").groupBy("trial").agg(F.round(0.5 * F.sum(F.abs(F.expr("try_divide(p, ps)") - F.expr("try_divide(q, qs)"))), 9).alias("tvd"))
    c = compounds(calls).join(masks, "plan_key").groupBy("compound").agg(*(F.bit_or(s).alias(s) for s in sides)).select(*sides)
    d = c.mapInPandas(unseen, "trial bigint, te bigint, new bigint").groupBy("trial").agg(F.sum("te").alias("te"), F.sum("new").alias("new")).where("te > 0")
    return t.join(d.select("trial", F.round(F.col("new") / F.col("te"), 9).alias("divergence")), "trial")


def constrained_split(calls: DataFrame, trials: int = TRIALS, max_tvd: float = 0.02, min_divergence: float = 0.1, seed: int = 42) -> DataFrame:
    """(plan_key, split) of the trial with most divergence among those whose atoms differ by ``max_tvd`` at most.

    If no trial meets both bounds, the one within twice ``max_tvd`` counts; if none does, the first trial.
    """
    s = trial_scores(calls, trials, seed)
    tier = F.when((F.col("tvd") <= max_tvd) & (F.col("divergence") >= min_divergence), 2).when(F.col("tvd") <= 2 * max_tvd, 1).otherwise(0)
    best = s.agg(F.max_by("trial", F.struct(tier, F.when(tier > 0, F.col("divergence")).otherwise(0.0), -F.col("trial"))).alias("trial"))  # one row
    keys = calls.select("plan_key").distinct().crossJoin(F.broadcast(best.where("trial is not null")))
    return keys.select("plan_key", _split(seed, F.col("trial"), (0.6, 0.2)).alias("split"))
