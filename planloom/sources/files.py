"""Reading and writing of the file formats: libraries, template banks, predictions, splits, manifests; made-up rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.plans.schemas import PROGRAM


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """(sub_id, program, support, mdl_gain) of JSON objects keyed by sub_id, one object per file."""
    entry = f"STRUCT<sub_id: STRING, program: {PROGRAM.simpleString()}, support: BIGINT, mdl_gain: DOUBLE>"
    text = spark.read.text(path, wholetext=True)
    e = text.select(F.explode(F.from_json("value", f"MAP<STRING, {entry}>")).alias("k", "e"))
    return e.select(F.coalesce("e.sub_id", "k").alias("sub_id"), "e.program", "e.support", "e.mdl_gain")


def write_library(library: DataFrame, path: str) -> None:
    """A library as JSON objects keyed by sub_id, one line per part of the table."""
    line = F.to_json(F.create_map("sub_id", F.struct("sub_id", "program", "support", "mdl_gain")))
    library.where("sub_id is not null").select(line.alias("value")).write.mode("overwrite").text(path)


def read_library_lines(spark: SparkSession, path: str) -> DataFrame:
    """A library written by ``write_library``."""
    entry = f"STRUCT<sub_id: STRING, program: {PROGRAM.simpleString()}, support: BIGINT, mdl_gain: DOUBLE>"
    return spark.read.text(path).select(F.explode(F.from_json("value", f"MAP<STRING, {entry}>")).alias("k", "e")).select("e.*")


def write_templates(templates: DataFrame, path: str) -> None:
    """A template bank as JSON objects keyed by template_id, one line per template."""
    entry = F.struct("template_id", "name", "domain", "variables", "steps", "reuse_count")
    templates.where("template_id is not null").select(F.to_json(F.create_map("template_id", entry)).alias("value")).write.mode("overwrite").text(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, name, domain, variables, steps, reuse_count) of JSON objects keyed by template_id, one or more per line."""
    entry = "STRUCT<template_id: STRING, name: STRING, domain: STRING, variables: ARRAY<STRUCT<name: STRING, type: STRING>>, steps: ARRAY<STRUCT<step_id: INT, operation: STRING, expression: STRING, inputs: ARRAY<STRING>, output_var: STRING>>, reuse_count: BIGINT>"
    e = spark.read.text(path).select(F.explode(F.from_json("value", f"MAP<STRING, {entry}>")).alias("k", "e"))
    return e.select(F.coalesce("e.template_id", "k").alias("template_id"), "e.name", "e.domain", "e.variables", "e.steps", F.coalesce("e.reuse_count", F.lit(0)).alias("reuse_count"))


def extracted(df: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], parts: int = 8, stop_after: int | None = None) -> DataFrame:
    """``work`` of ``df``, done part by part of a hash of ``key`` and written to ``path``; parts that are done are not done again.

    A part is finished when its own marker of success is written, so a run that was cut off goes on with the part that it
    was in. stop_after: parts to do in this run, for tests. The result is read from what is written.
    """
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = 0
    for i in range(parts):
        here = f"{path}/part={i}"
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{here}/_SUCCESS")):
            continue
        if stop_after is not None and done >= stop_after:
            break
        work(df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)).write.mode("overwrite").parquet(here)
        done += 1
    return spark.read.parquet(path).drop("part")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(value VARIANT): records of JSON lines, of a JSON list, of one under a well-known key, or of all lists of an object."""
    text = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    keyed = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("predictions", "results", "data", "records")))
    lists = F.flatten(F.filter(F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: x.isNotNull()))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    one_per_line = F.size(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")) > 1
    records = F.when(one_per_line & F.col("value").rlike(r"^\s*\{[^\n]*\}\s*\n"), lines).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), keyed, lists))
    return text.select(F.explode(records).alias("value"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are left out."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_sweep(spark: SparkSession, root: str) -> DataFrame:
    """One ``sweep_meta.json`` per directory below ``root``, with the directory's name as condition."""
    df = spark.read.json(f"{root}/*/sweep_meta.json", multiLine=True)
    return df.withColumn("condition", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/sweep_meta\.json$", 1))


def write_split(split: DataFrame, path: str) -> None:
    """(plan_key, split) partitioned by split."""
    split.write.mode("overwrite").partitionBy("split").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("plan_key bigint, split string").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes, sha256, head16): of each file its size, SHA-256, and 16 digits of that of its first MiB."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"),
        F.substring(F.sha2(F.substring("content", 1, 1048576), 256), 1, 16).alias("head16"),
    )


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash of their key: the same ones whenever it runs."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def made_problems(spark: SparkSession, n: int) -> DataFrame:
    """(i, problem, answer): sums by formula, a = (7i + 3) % 100 + 1 and b = (11i + 5) % 100 + 1."""
    i = F.col("i")
    d = spark.range(n).select(F.col("id").alias("i")).withColumns({"a": (7 * i + 3) % 100 + 1, "b": (11 * i + 5) % 100 + 1})
    return d.select("i", F.format_string("What is %d plus %d?", "a", "b").alias("problem"), (F.col("a") + F.col("b")).cast("string").alias("answer"))


def in_split(df: DataFrame, key: str, members: DataFrame, index: str, ident: str | None = None) -> DataFrame:
    """Rows whose key is in ``members.index``, or whose ``ident`` is in ``members.ident``: two semi-joins, no row twice."""
    a = df.join(members.select(F.col(index).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    if ident is None:
        return a
    b = df.join(members.select(F.col(index).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return a.unionByName(b.join(members.select(ident).where(F.col(ident).isNotNull()).distinct(), ident, "left_semi").select(*a.columns))


def first_present(*columns: Column) -> Column:
    """The first of some texts that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))
