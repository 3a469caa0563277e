"""Struct types of slots, steps, programs, references, calls and plans."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SLOT = T.StructType(_strings("name", "dtype", "description"))
STEP = T.StructType([*_strings("op", "target", "expr"), T.StructField("inputs", T.ArrayType(T.StringType())), *_strings("target_dtype")])
PROGRAM = T.StructType(
    [*_strings("program_id"), T.StructField("slots", T.ArrayType(SLOT)), T.StructField("steps", T.ArrayType(STEP)), *_strings("source")]
)
REF = T.StructType([*_strings("source"), T.StructField("value", T.DoubleType()), *_strings("call_id", "dtype", "qid", "span", "entity", "role")])
HINT = T.StructType([T.StructField("value", T.DoubleType()), *_strings("dtype"), T.StructField("confidence", T.DoubleType())])
CALL = T.StructType([*_strings("call_id", "sub_id"), T.StructField("bindings", T.MapType(T.StringType(), REF)), T.StructField("value_hint", HINT)])
PLAN = T.StructType([T.StructField("calls", T.ArrayType(CALL)), T.StructField("final", REF)])
