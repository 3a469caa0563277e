"""Keys that hold a large part of all rows: found by exact counts, and spread over salts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes.
HOT_ROWS = 50_000
#: Most keys that are told to all tasks.
MOST_HOT = 1_000_000


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, salts) of the keys with more than ``hot_rows`` rows, and into how many parts of that size theirs are spread.

    Counts are partial before the shuffle, so a hot key sends one row a task. There can't be more hot keys than rows
    divided by ``hot_rows``; where that would be more than ``MOST_HOT``, the bound of a task is raised until it isn't.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    bound = max(hot_rows, -(-total // MOST_HOT))
    return counts.where(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).cast("bigint").alias("salts"))


def salted(many: DataFrame, few: DataFrame, keys: list[str], by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The join of two tables on ``keys``. Rows of ``many`` with a hot key are spread over salts by the column ``by``; ``few`` has a copy for each salt."""
    hot = F.broadcast(hot_keys(many, keys, hot_rows))  # bounded, see there
    spread = lambda df: df.join(hot, keys, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = spread(many).withColumn("_salt", F.pmod(F.xxhash64(by), "salts")).drop("salts")
    right = spread(few).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
