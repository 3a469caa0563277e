"""Problem 4: how often two items occur in the same basket, and how this compares with chance.

Heavy-light decomposition. Items in at least ``HEAVY_SHARE`` of the baskets are heavy, of them at most ``MAX_HEAVY``, the
most frequent ones, as a task holds a matrix of their counts. Each task turns its baskets into a bit matrix of the heavy
items and counts their pairs by popcount; of every rare item the list of its baskets probes the bits of the heavy ones,
all rare items of a batch at once. Pairs of two rare items are counted by hash, as rows: a basket with many of them is cut
into parts first, and every two parts are rows of their own, so no basket burdens a task. The partial counts of all three
are added up, and lift is scored from them. Which way counts a pair changes nothing in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.session import cut

#: Share of the baskets from which on an item is heavy.
HEAVY_SHARE = 1 / 200
#: Most heavy items, for the size of a task's matrix of counts (32 MB).
MAX_HEAVY = 2048
#: Rare items of a basket that are paired in one row; longer baskets are cut into parts of that size.
PART = 256
#: Bits of the matrix that are probed at once.
PROBED = 1 << 24


def baskets(df: DataFrame, key: str, items: str) -> DataFrame:
    """(basket, items): one row per key with its distinct items, rows delivered again once, empty and null lists as empty."""
    plain = F.array_sort(F.array_compact(F.array_distinct(F.coalesce(F.col(items), F.array().cast("array<string>")))))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("basket")).agg(F.max(plain).alias("items"))


def respelled(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """``df`` (basket, items) with items as ``names`` spells them, whatever their case and the blanks around them.

    Items unknown to ``names`` are left out, baskets stay. The names' side is joined by Spark's own choice of join.
    """
    key = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", "")))
    known = names.where(F.col(name).isNotNull()).groupBy(key(F.col(name)).alias("_k")).agg(F.min(name).alias("_name"))
    rows = df.select("basket", F.explode_outer(column).alias("_i")).select("basket", key(F.col("_i")).alias("_k")).join(known, "_k", "left")
    return rows.groupBy("basket").agg(F.collect_set("_name").alias("items"))  # a set leaves out nulls


def _with_heavy(n_heavy: int):
    """Partial counts of the pairs of two heavy items, and of a heavy and a rare one, of a task's baskets (heavy, light)."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros((n_heavy, n_heavy), np.int64)
        for batch in batches:
            n = len(batch)
            bits = np.zeros((n_heavy, -(-n // 64) * 64), np.uint8)
            sizes = [len(x) for x in batch["heavy"]]
            if sum(sizes):
                bits[np.concatenate(list(batch["heavy"])).astype(np.int64), np.repeat(np.arange(n), sizes)] = 1
            words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
            for i in range(n_heavy):
                dense[i, i:] += np.bitwise_count(words[i] & words[i:]).sum(axis=1, dtype=np.int64)
            rare = np.concatenate([np.zeros(0, np.int64), *batch["light"]]).astype(np.int64)
            order = np.argsort(rare, kind="stable")
            rare, at = rare[order], np.repeat(np.arange(n), [len(x) for x in batch["light"]])[order]
            step = max(1, PROBED // max(1, n_heavy))
            for a in range(0, len(rare), step):
                values, starts = np.unique(rare[a : a + step], return_index=True)
                hits = np.add.reduceat(bits[:, at[a : a + step]], starts, axis=1, dtype=np.int64)  # lists probe the bits
                which, of = np.nonzero(hits)
                if len(which):
                    yield pd.DataFrame({"a": which, "b": values[of], "n": hits[which, of]})
        a, b = np.nonzero(np.triu(dense, 1))
        yield pd.DataFrame({"a": a, "b": b, "n": dense[a, b]})

    return pairs


def _rare_pairs(lists: DataFrame, part: int) -> DataFrame:
    """(a, b, n = 1) of every two rare items of a basket, a < b; light is sorted."""
    short = lists.where((F.size("light") > 1) & (F.size("light") <= part)).select(F.col("light").alias("x"), F.lit(None).cast("array<bigint>").alias("y"))
    n_parts = F.ceil(F.size("light") / part).cast("int")
    cuts = lists.where(F.size("light") > part).withColumn("parts", F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: F.slice("light", i * part + 1, part)))
    first = cuts.select("parts", F.posexplode("parts").alias("i", "x")).select("x", F.explode(F.expr("slice(parts, i + 1, size(parts))")).alias("y"))
    # a part with itself is one list; a fixed number of tasks, since few rows become many
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = first.select("x", F.when(F.col("x")[0] != F.col("y")[0], F.col("y")).alias("y")).repartition(tasks)
    both = short.unionByName(long).select("x", "y", F.posexplode("x").alias("k", "a"))
    others = F.coalesce("y", F.expr("slice(x, k + 2, size(x))"))
    return both.select("a", F.explode(others).alias("b")).select("a", "b", F.lit(1).cast("bigint").alias("n"))


def coded(singles: DataFrame, top: list[str]) -> DataFrame:
    """``singles`` (item, n_item) with a code of its own for each item: its place in ``top``, for others by hash, beyond.

    Items of the same hash, of 50 bits, are told apart by their order, so no two share a code.
    """
    heavy = singles.sparkSession.createDataFrame([(x, i) for i, x in enumerate(top)], "item string, place bigint")  # at most MAX_HEAVY
    light = singles.join(F.broadcast(heavy), "item", "left_anti").withColumn("_h", F.shiftrightunsigned(F.xxhash64("item"), 14))
    rank = F.row_number().over(Window.partitionBy("_h").orderBy("item")) - 1
    light = light.select("item", "n_item", (F.lit(len(top)) + F.shiftleft("_h", 12) + rank).alias("code"))
    return singles.join(F.broadcast(heavy), "item").select("item", "n_item", F.col("place").alias("code")).unionByName(light)


def cooccurrence(df: DataFrame, min_count: int = 1, min_share: float = 0.0, heavy_share: float = HEAVY_SHARE, max_heavy: int = MAX_HEAVY, part: int = PART) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_baskets, lift) for each pair with n_both >= min_count and >= min_share * n.

    df: (basket, items ARRAY<STRING> without repeats). item_a < item_b. lift = n_both * n / (n_a * n_b). An item that
    itself is in fewer baskets than a pair needs can be in no such pair and is dropped before pairs are counted, which
    loses nothing. Empty baskets count in n. No baskets: no rows.
    """
    df = cut(df)
    n = df.count()
    least = max(min_count, int(np.ceil(min_share * n - 1e-9)), 1)
    singles = cut(df.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least))
    top = [r.item for r in singles.where(F.col("n_item") >= max(1, heavy_share * n)).orderBy(F.desc("n_item"), "item").limit(max_heavy).collect()]
    n_heavy = len(top)
    codes = cut(coded(singles, top))
    is_heavy: Column = F.col("code") < n_heavy
    lists = cut(
        df.select("basket", F.explode("items").alias("item"))
        .join(codes.select("item", "code"), "item")
        .groupBy("basket")
        .agg(F.collect_list(F.when(is_heavy, F.col("code"))).alias("heavy"), F.array_sort(F.collect_list(F.when(~is_heavy, F.col("code")))).alias("light"))
        .where(F.size("heavy") + F.size("light") > 1)
        .select("heavy", "light")
    )
    partial = lists.where(F.size("heavy") > 0).mapInPandas(_with_heavy(n_heavy), "a bigint, b bigint, n bigint").unionByName(_rare_pairs(lists, part))
    counted = partial.groupBy("a", "b").agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= least)
    side = lambda x: codes.select(F.col("code").alias(x), F.col("item").alias(f"i_{x}"), F.col("n_item").alias(f"c_{x}"))
    first = F.col("i_a") < F.col("i_b")
    return counted.join(side("a"), "a").join(side("b"), "b").select(
        F.when(first, F.col("i_a")).otherwise(F.col("i_b")).alias("item_a"),
        F.when(first, F.col("i_b")).otherwise(F.col("i_a")).alias("item_b"),
        "n_both",
        F.when(first, F.col("c_a")).otherwise(F.col("c_b")).alias("n_a"),
        F.when(first, F.col("c_b")).otherwise(F.col("c_a")).alias("n_b"),
        F.lit(n).cast("bigint").alias("n_baskets"),
        (F.col("n_both") * F.lit(float(n)) / (F.col("c_a") * F.col("c_b"))).alias("lift"),
    )


def plan_baskets(plans: DataFrame, library: DataFrame) -> DataFrame:
    """(basket, items) of dataflow plans: each plan_key with the library entries that it calls."""
    return respelled(baskets(plans.withColumn("_subs", F.col("calls.sub_id")), "plan_key", "_subs"), "items", library, "sub_id")


def pattern_baskets(patterns: DataFrame, library: DataFrame) -> DataFrame:
    """(basket, items) of composition patterns."""
    return respelled(baskets(patterns, "pattern_id", "sub_ids"), "items", library, "sub_id")


def found_pairs(plans: DataFrame, patterns: DataFrame, library: DataFrame, min_count: int = 5, min_share: float = 0.003, min_lift: float = 3.0) -> DataFrame:
    """(basket_kind, sub_id_a, sub_id_b, n_both, n_a, n_b, n_baskets, lift) of the pairs that occur together more than by chance."""
    def side(kind: str, df: DataFrame) -> DataFrame:
        pairs = cooccurrence(df, min_count, min_share).where((F.col("n_both") * F.col("n_baskets")) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
        return pairs.select(F.lit(kind).alias("basket_kind"), F.col("item_a").alias("sub_id_a"), F.col("item_b").alias("sub_id_b"), "n_both", "n_a", "n_b", "n_baskets", "lift")

    return side("plan", plan_baskets(plans, library)).unionByName(side("pattern", pattern_baskets(patterns, library)))
