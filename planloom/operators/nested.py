"""Deeply nested, semi-structured records turned into related flat tables.

Records come as VARIANT, so typed columns (``to_variant_object``) and text (``json_variant``) take one path.
``relationalize`` infers the merged schema of a level, makes its scalars columns, flattens its objects, and
explodes every array and every object that is used as a map into a child table, whose levels are treated the same way;
an array that is itself an element of an array becomes a level of its own. Which objects are maps is declared, not guessed,
so the tables of the same kind of records have the same shape however many of them are read.

Every row carries ``node_id`` (its surrogate key: record key and the ordinals on the way down, so it is the same
whenever and wherever a lost task is run again), ``parent_id`` and the ordinals of all levels above it.
A node that is an array in some records and an object in others gives one child table with the rows of both.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The name of the level of arrays that are elements of arrays.
ELEMENT = "element"


def json_variant(text: Column) -> Column:
    """The JSON value that ``text`` is or holds (behind a heading, in a fence, before closing words); NULL if broken.

    Null, blank and truncated texts give NULL. The whole text is tried first, then what begins at its first brace,
    then at the first brace before a quoted name.
    """
    def at(pattern: str) -> Column:
        return F.try_parse_json(F.regexp_extract(text, pattern, 0))

    parsed = F.coalesce(F.try_parse_json(text), at(r"(?s)\{.*"), at(r'(?s)\{\s*".*'))
    return F.when(text.isNotNull() & ~F.is_variant_null(parsed), parsed)


def _held(v: Column) -> Column:
    """The array or object that ``v`` holds as a string of JSON; NULL if it holds none."""
    inner = F.try_variant_get(v, "$", "string")
    return F.when(inner.rlike(r"^\s*[\[{]"), F.try_parse_json(inner))


def reparsed(v: Column) -> Column:
    """``v``, or the array or object that it holds as a string of JSON."""
    array = F.try_variant_get(v, "$", "array<variant>").isNotNull()
    return F.when(array | F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v).otherwise(F.coalesce(_held(v), v))


@dataclass
class Shape:
    """The merged type of a level: scalar fields by SQL type, objects, arrays, maps, and fields of several kinds."""

    scalars: dict[str, str] = field(default_factory=dict)
    objects: dict[str, str] = field(default_factory=dict)
    children: dict[str, str] = field(default_factory=dict)


def split_fields(ddl: str) -> dict[str, str]:
    """Names and types in ``OBJECT<a: T, b: T>``; {} for any other type."""
    if not ddl or not ddl.startswith("OBJECT<"):
        return {}
    body, out, depth, start, quoted = ddl[7:-1], {}, 0, 0, False
    parts = []
    for i, c in enumerate(body):
        if c == "`":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "<(":
            depth += 1
        elif c in ">)":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    parts.append(body[start:])
    for p in parts:
        m = re.match(r"\s*(?:`((?:[^`]|``)*)`|([^:]+)):\s*(.*)", p, re.S)
        if m:
            out[(m[1] or m[2] or "").replace("``", "`")] = m[3].strip()
    return out


def merged_schema(df: DataFrame, column: str) -> str:
    """The merged type of a VARIANT column over all rows, as one distributed aggregate; only its text comes to the driver."""
    return df.agg(F.schema_of_variant_agg(F.col(column))).first()[0] or "VOID"


def level_schema(df: DataFrame, column: str) -> tuple[str, bool]:
    """The merged type of the objects in a VARIANT column, and whether any row of it is an array."""
    v = F.col(column)
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    row = df.agg(F.schema_of_variant_agg(F.when(is_object, v)), F.bool_or(F.try_variant_get(v, "$", "array<variant>").isNotNull())).first()
    return row[0] or "VOID", bool(row[1])


def _known(like: T.DataType | None, name: str) -> T.DataType | None:
    return like[name].dataType if isinstance(like, T.StructType) and name in like.fieldNames() else None


def _below(like: T.DataType | None, name: str) -> T.DataType | None:
    known = _known(like, name)
    while isinstance(known, (T.ArrayType, T.MapType)):
        known = known.elementType if isinstance(known, T.ArrayType) else known.valueType
    return known if isinstance(known, T.StructType) else None


def shape_of(ddl: str, like: T.DataType | None = None, maps: frozenset[str] = frozenset()) -> Shape:
    """Which fields of a level become columns, flattened objects or child tables; ``maps`` are the names of fields that are maps."""
    shape, found = Shape(), split_fields(ddl)
    if isinstance(like, T.StructType):  # fields that no record happens to have
        found |= {f.name: "VOID" for f in like.fields if f.name not in found}
    for name, kind in found.items():
        known = _known(like, name)
        if isinstance(known, T.StructType):  # an object by contract; scalars in its place are kept as <name>_scalar
            shape.objects[name] = kind
        elif kind.startswith("ARRAY<") or isinstance(known, (T.ArrayType, T.MapType)) or (name in maps and kind.startswith("OBJECT<")):
            shape.children[name] = kind
        elif kind.startswith("OBJECT<"):
            shape.objects[name] = kind
        elif kind == "VARIANT" and known is None:  # several kinds: rows from arrays and objects, text of scalars
            shape.children[name] = kind
            shape.scalars[name] = "string"
        else:
            sql = "double" if re.match(r"DECIMAL|DOUBLE|FLOAT", kind) else {"BIGINT": "bigint", "BOOLEAN": "boolean"}.get(kind, "string")
            shape.scalars[name] = known.simpleString() if known is not None else sql
    return shape


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", kind)


def entries(v: Column, key_field: str | None) -> Column:
    """The elements of an array or the fields of an object as ARRAY<STRUCT<key STRING, value VARIANT>>, in their order.

    The key of an array's element is the element's own ``key_field``, if it has one.
    """
    key = (lambda e: _get(e, key_field, "string")) if key_field else (lambda e: F.lit(None).cast("string"))

    def of_array(x: Column) -> Column:
        return F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda e: F.struct(key(e).alias("key"), e.alias("value")))

    def of_object(x: Column) -> Column:
        return F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    held = _held(v)  # only looked at where v itself is neither
    return F.coalesce(of_array(v), of_object(v), of_array(held), of_object(held))


def relationalize(
    df: DataFrame,
    key: str,
    column: str,
    name: str = "root",
    like: T.StructType | None = None,
    key_fields: dict[str, str] | None = None,
    maps: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Flat tables of the VARIANT ``column`` of ``df``, one per level, by the name of the level.

    key: the record key (unique, not null; rows with a null key give no rows). like: a known struct type, merged with
    what is inferred (its MAP fields are maps). maps: names of further fields whose objects are maps. key_fields: for a child whose maps may also be written as an array of
    objects, the field of those objects that holds the key.
    A null record, a null or empty array or object has no child rows; a null element is a row without values.
    Extra columns of ``df`` are left out. Objects flatten to ``<object>_<field>``, with ``<object>_present``.
    Ordinals are ``<level>_pos``, map keys ``<level>_key``. An array or map within objects is named by its path, with
    dots in the table's name. An array that is itself an element of an array is a row, and its elements are rows of the
    level ``element`` below; in ``scalar`` it is NULL.
    """
    base = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(
        key, F.col(column).alias("_v"), F.concat_ws("/", F.col(key).cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id")
    )
    tables: dict[str, DataFrame] = {}
    _level(base, name, [key], like, key_fields or {}, frozenset(maps), tables)
    return tables


def _level(df: DataFrame, name: str, carried: list[str], like, key_fields: dict[str, str], maps: frozenset[str], tables: dict[str, DataFrame]) -> None:
    ddl, arrays = level_schema(df, "_v")
    shape = shape_of(ddl, like if isinstance(like, T.StructType) else None, maps)
    v = F.col("_v")
    columns = {c: F.col(c) for c in [*carried, "node_id", "parent_id"]}
    text = F.try_variant_get(v, "$", "string")
    columns["scalar"] = F.when(F.try_variant_get(v, "$", "array<variant>").isNull() & F.try_variant_get(v, "$", "map<string,variant>").isNull(), text)
    children: list[tuple[str, str, Column, object]] = []  # path, field, value, what is known of its elements

    def flatten(prefix: str, v: Column, shape: Shape, like, path: str = "") -> None:
        children.extend((f"{path}{f}", f, _get(v, f, "variant"), _below(like, f)) for f in shape.children)
        for f, kind in shape.scalars.items():
            columns.setdefault(f"{prefix}{f}", _get(v, f, kind))
        for f, ddl in shape.objects.items():
            inner = reparsed(_get(v, f, "variant"))
            columns.setdefault(f"{prefix}{f}_present", inner.isNotNull() & ~F.coalesce(F.is_variant_null(inner), F.lit(True)))
            flatten(f"{prefix}{f}_", inner, shape_of(ddl, _below(like, f), maps), _below(like, f), f"{path}{f}.")

    flatten("", v, shape, like)
    if arrays and name != "root":
        children.append((ELEMENT, ELEMENT, F.when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), v), like))
    tables[name] = df.select(*(c.alias(n) for n, c in columns.items()))
    for f, last, inner, below_like in children:
        child = f"{name}.{f}" if "." in name or name != "root" else f
        pos, key_name = _ordinals(f, child, carried)
        exploded = df.select(*carried, F.col("node_id").alias("parent_id"), F.posexplode(entries(inner, key_fields.get(last))).alias(pos, "_e"))
        below = exploded.select(
            *carried,
            F.col(pos).cast("bigint").alias(pos),
            F.col("_e.key").alias(key_name),
            F.col("_e.value").alias("_v"),
            "parent_id",
            F.concat_ws("/", "parent_id", F.lit(f), F.col(pos).cast("string")).alias("node_id"),
        )
        _level(below, child, [*carried, pos, key_name], below_like, key_fields, maps, tables)


def _ordinals(path: str, child: str, carried: list[str]) -> tuple[str, str]:
    """Names of a level's ordinal and key: by its path, or if that is taken above, by the whole name of its table."""
    at = path.replace(".", "_")
    if f"{at}_pos" in carried:
        at = child.replace(".", "_")
    return f"{at}_pos", f"{at}_key"


def relationalize_declared(df: DataFrame, key: str, column: str, name: str = "root", key_fields: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """As ``relationalize``, of a struct ``column``: its declared schema is walked and nothing is inferred or parsed.

    The tables have the same names and columns, so those of texts and of typed rows unite by name.
    """
    kind = df.schema[column].dataType
    base = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(
        key, F.col(column).alias("_v"), F.col(key).cast("string").alias("node_id"), F.lit(None).cast("string").alias("parent_id")
    )
    tables: dict[str, DataFrame] = {}
    _declared_level(base, name, [key], kind, key_fields or {}, tables)
    return tables


def _declared_level(df: DataFrame, name: str, carried: list[str], kind: T.DataType, key_fields: dict[str, str], tables: dict[str, DataFrame]) -> None:
    columns = {c: F.col(c) for c in [*carried, "node_id", "parent_id"]}
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    columns["scalar"] = F.lit(None).cast("string") if nested else F.col("_v").cast("string")
    children: list[tuple[str, str, Column, T.DataType]] = []

    def flatten(prefix: str, v: Column, struct: T.StructType, path: str = "") -> None:
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                columns[f"{prefix}{f.name}_present"] = v[f.name].isNotNull()
                flatten(f"{prefix}{f.name}_", v[f.name], f.dataType, f"{path}{f.name}.")
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                children.append((f"{path}{f.name}", f.name, v[f.name], f.dataType))
            else:
                columns[f"{prefix}{f.name}"] = v[f.name]

    if isinstance(kind, T.StructType):
        flatten("", F.col("_v"), kind)
    elif nested:
        children.append((ELEMENT, ELEMENT, F.col("_v"), kind))
    tables[name] = df.select(*(c.alias(n) for n, c in columns.items()))
    for f, last, v, t in children:
        child = f"{name}.{f}" if "." in name or name != "root" else f
        pos, key_name = _ordinals(f, child, carried)
        parent = F.col("node_id").alias("parent_id")
        if isinstance(t, T.MapType):
            rows, below = df.select(*carried, parent, F.posexplode(v).alias(pos, "_k", "_v")), t.valueType
        else:
            rows, below = df.select(*carried, parent, F.posexplode(v).alias(pos, "_v")), t.elementType
            field_ = key_fields.get(last)
            own = F.col("_v")[field_].cast("string") if isinstance(below, T.StructType) and field_ in below.fieldNames() else F.lit(None).cast("string")
            rows = rows.withColumn("_k", own)
        level = rows.select(
            *carried,
            F.col(pos).cast("bigint").alias(pos),
            F.col("_k").cast("string").alias(key_name),
            "_v",
            "parent_id",
            F.concat_ws("/", "parent_id", F.lit(f), F.col(pos).cast("string")).alias("node_id"),
        )
        _declared_level(level, child, [*carried, pos, key_name], below, key_fields, tables)


def united(*tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of the same names put together; columns that one lacks are null."""
    out: dict[str, DataFrame] = {}
    for group in tables:
        for name, df in group.items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out
