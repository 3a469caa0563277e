"""Helpers on columns of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row, however often later expressions and filters use them."""
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", row.alias("_once")).select("*", "_once.*").drop("_once")
