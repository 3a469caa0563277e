"""Streaming forms: counts by window of events that may come late, and a memory that learns by key as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_funnel(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value): events by window and type. Works on a stream and, with the same rows, on a table.

    ``ts`` may be without zone: it is taken as UTC time. Events later than ``late`` behind the newest one are dropped
    from a stream; rows without a time belong to no window.
    """
    e = events.where(F.col(ts).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_ts", late)
    g = e.groupBy(F.window("_ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def running_memory(rows: DataFrame, key: str, utilities: list[str]) -> DataFrame:
    """(key, action, n): for each key after each batch the utility column with the highest mean so far, of a stream of rows."""
    names = list(utilities)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, *sums = state.get if state.exists else (0, *[0.0] * len(names))
        for b in batches:
            n += len(b)
            sums = [s + float(b[c].sum()) for s, c in zip(sums, names)]
        state.update((n, *sums))
        best = max(range(len(names)), key=lambda i: (sums[i], -i)) if n else 0
        yield pd.DataFrame({key: [k[0]], "action": [names[best]], "n": [n]})

    kind = dict(rows.dtypes)[key]
    state = "n bigint, " + ", ".join(f"s{i} double" for i in range(len(names)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, action string, n bigint", state, "update", "NoTimeout")


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there now, in update mode, and append what it gives to ``path``; it ends with its source."""
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).start().awaitTermination()
