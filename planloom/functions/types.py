"""The six value types, as columns and as values; NULL (or ``ValueError``) where a value can't be of the type."""

from __future__ import annotations

import math

#: The value types (fixed values).
DTYPES = ("int", "float", "string", "bool", "list[int]", "list[float]")


def coerce_sql(value: str, dtype: str, of_string: bool = False) -> str:
    """SQL of a scalar coerced to a type. int goes through float and truncates; a non-empty string is a true bool."""
    kind = (dtype or "float").strip().lower()
    number = f"try_cast({value} AS DOUBLE)"
    finite = f"nullif(nullif(nullif({number}, double('NaN')), double('inf')), double('-inf'))"
    if kind == "int":
        return f"try_cast({finite} AS BIGINT)"
    if kind == "float":
        return number
    if kind == "string":
        return f"CAST({value} AS STRING)"
    if kind == "bool":
        return f"({value} <> '')" if of_string else f"(try_cast({value} AS DOUBLE) <> 0)"
    if kind in ("list[int]", "list[float]"):
        return f"array({coerce_sql(value, kind[5:-1], of_string)})"
    raise ValueError(f"unknown type {dtype}")


def coerce(value, dtype: str):
    """A value coerced to a type; raises ``ValueError``."""
    kind = (dtype or "float").strip().lower()
    try:
        if kind == "int":
            x = float(value)
            if not math.isfinite(x):
                raise ValueError("not finite")
            return int(x)
        if kind == "float":
            return float(value)
        if kind == "string":
            return str(value)
        if kind == "bool":
            return bool(value)
        if kind == "list[int]":
            return [int(x) for x in value] if isinstance(value, (list, tuple)) else [coerce(value, "int")]
        if kind == "list[float]":
            return [float(x) for x in value] if isinstance(value, (list, tuple)) else [coerce(value, "float")]
    except (TypeError, OverflowError) as x:
        raise ValueError(str(x)) from x
    raise ValueError(f"unknown type {dtype}")
