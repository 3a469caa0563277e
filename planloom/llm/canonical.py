"""Problem 3: records that differ only in how they are written, collapsed into one each.

The canonical form of a program keeps what counts and drops layout, letter case, punctuation and the order of slots and
inputs. Equal records share the SHA-256 of that form. Keys that hold more rows than a task takes are found exactly by
partial counts (their number is bounded by that, and so is what is broadcast); their rows are salted, by as many salts as
their count asks for, and aggregated in two levels, the rest in one shuffle. The representative is the smallest
identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.skew import HOT_ROWS, hot_keys
from planloom.plans.programs import parsed_programs
from planloom.session import cut


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _name(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(_lower(c), r"[^\p{L}\p{N}]+", "")


def _expr(c: Column) -> Column:
    """Letters, digits and the characters of expressions only, lower case."""
    return F.regexp_replace(_lower(c), r"[^\p{L}\p{N}+\-*/%().<>=!]+", "")


def canonical_form(slots: Column, steps: Column) -> Column:
    """The text that two programs share if and only if they are the same record; NULL if both parts are null.

    Null fields, null elements and missing lists are as empty ones. Slots and inputs are sorted, steps keep their order.
    """
    slot = F.array_sort(F.transform(slots, lambda s: F.concat_ws("\x1f", _name(s["name"]), _lower(s["dtype"]))))
    step = F.transform(
        steps,
        lambda s: F.concat_ws(
            "\x1f",
            _lower(s["op"]),
            _name(s["target"]),
            _expr(s["expr"]),
            F.coalesce(F.array_join(F.array_sort(F.transform(s["inputs"], _name)), "\x1e"), F.lit("")),
            _lower(s["target_dtype"]),
        ),
    )
    text = F.concat_ws("\x1c", F.array_join(slot, "\x1d"), F.lit("|"), F.array_join(step, "\x1d"))
    return F.when(slots.isNotNull() | steps.isNotNull(), text)


def program_keys(programs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, key, slots, steps): the typed program of a row, or where it has none that of its JSON text in ``output``.

    Rows without a program (both null, text broken or empty) and rows with a null id are left out.
    """
    parts = parsed_programs(programs.where(F.col(id_col).isNotNull())).select(F.col(id_col).alias("id"), "slots", "steps")
    return parts.withColumn("key", F.sha2(canonical_form(F.col("slots"), F.col("steps")), 256)).where("key is not null")


def collapse(keyed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, key, keep_id, n_copies) for each row of ``keyed`` (id, key), in the two ways told above.

    Repeated rows of one id count once. An empty table gives no rows.
    """
    rows = cut(keyed.select("id", "key"))
    hot = F.broadcast(cut(hot_keys(rows, ["key"], hot_rows)))  # bounded, see there

    salted = rows.join(hot, "key").dropDuplicates(["key", "id"])
    first = salted.groupBy("key", F.pmod(F.xxhash64("id"), "salts").alias("salt")).agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    second = first.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n_copies"))  # a row per hot key
    hot_rows_ = salted.join(F.broadcast(second), "key")

    w = Window.partitionBy("key")
    rest = rows.join(hot, "key", "left_anti").dropDuplicates(["key", "id"])
    cold_rows = rest.select("key", "id", F.min("id").over(w).alias("keep_id"), F.count("*").over(w).alias("n_copies"))
    return hot_rows_.select("id", "key", "keep_id", "n_copies").unionByName(cold_rows.select("id", "key", "keep_id", "n_copies"))


def program_copies(programs: DataFrame) -> DataFrame:
    """(keep_id, copy_id): every row that repeats a record, with the smallest row_id of that record."""
    out = collapse(program_keys(programs))
    return out.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def program_records(programs: DataFrame) -> DataFrame:
    """(row_id, record_key, n_copies): one row per record, with how many rows hold it."""
    out = collapse(program_keys(programs))
    return out.where("id = keep_id").select(F.col("id").alias("row_id"), F.col("key").alias("record_key"), "n_copies")
