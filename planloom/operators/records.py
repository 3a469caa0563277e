"""Records for training and evaluation: named unions, controls on plans, prompts and texts, positions, rows by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Operations and value types that a program may have (fixed values).
OPS = ("assign", "compute", "compare", "aggregate", "condition", "output")
DTYPES = ("int", "float", "string", "bool", "list[int]", "list[float]")


def named_union(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Tables put together, all rows, with the name of each in a column; columns that one lacks are null. No tables: an error."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(name, F.lit(n)) for n, df in parts.items()))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of ``key``; rows with a null key come last."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def at_positions(df: DataFrame, index: str, positions: DataFrame, position: str) -> DataFrame:
    """Rows whose ``index`` is one of ``positions``, once for each time it is there; positions beyond the rows give none."""
    return positions.where(F.col(position).isNotNull()).join(df.withColumnRenamed(index, position), position)


def products(rows: DataFrame, index: str, text: str) -> DataFrame:
    """(index, a, b, result): the first two numbers of a text and their product; where it has fewer, two by formula from the index."""
    found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)), lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())
    i = F.col(index)
    made = F.array(((i * 7 + 3) % 100 + 1).cast("double"), ((i * 11 + 5) % 50 + 1).cast("double"))
    pair = F.when(F.size(found) >= 2, found).otherwise(made)
    return rows.select(index, F.get(pair, F.lit(0)).alias("a"), F.get(pair, F.lit(1)).alias("b")).withColumn("result", F.col("a") * F.col("b"))


def chat_text(system: Column, user: Column, assistant: Column) -> Column:
    """A conversation of three messages in the markup of chat models (fixed value: the marks)."""
    said = lambda role, x: F.concat(F.lit(f"<|im_start|>{role}\n"), x, F.lit("<|im_end|>"))
    return F.concat_ws("\n", said("system", system), said("user", user), said("assistant", assistant))


def store_problems(spark: SparkSession, n: int, mode: str = "flat", system: str = "") -> DataFrame:
    """(i, text): made problems on the cost of items, as chat, answered by a plan (mode 'compose') or by a program."""
    i = F.col("i")
    d = spark.range(n).select(F.col("id").alias("i")).withColumns({"a": (i * 7 + 3) % 100 + 1, "b": (i * 11 + 5) % 50 + 1})
    problem = F.format_string("A store has %d items at $%d each. What is the total cost?", "a", "b")
    if mode == "compose":
        answer = F.format_string('{"plan": [{"sub_id": "L00", "bindings": {"quantity": %d, "price": %d}}]}', "a", "b")
    else:
        answer = F.format_string(
            '{"program_id": "flat_%d", "slots": [{"name": "quantity", "dtype": "int"}, {"name": "price", "dtype": "float"}], "steps": [{"op": "compute", "target": "total", "expr": "quantity * price"}, {"op": "output", "target": "__output__", "expr": "total"}]}',
            "i",
        )
    return d.select("i", chat_text(F.lit(system), F.concat(F.lit("Problem: "), problem), answer).alias("text"))


def template_prompts(templates: DataFrame) -> DataFrame:
    """(template_id, prompt): a template as text: its name, its variables and its numbered steps; null lists are as empty ones."""
    names = F.array_join(F.transform(F.coalesce("variables", F.expr("array()").cast(templates.schema["variables"].dataType)), lambda v: v["name"]), ", ")
    steps = F.transform(F.coalesce("steps", F.expr("array()").cast(templates.schema["steps"].dataType)), lambda s: F.concat(F.lit("  "), s["step_id"].cast("string"), F.lit(". ["), s["operation"], F.lit("] "), s["expression"]))
    lines = F.concat(F.array(F.concat(F.lit("Template: "), F.coalesce("name", F.lit(""))), F.concat(F.lit("Variables: "), names), F.lit("Steps:")), steps)
    return templates.select("template_id", F.array_join(lines, "\n").alias("prompt"))


def rows_by_key(df: DataFrame, key: str, order: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows of each key in the order of a hash: the same ones whenever it runs. Null keys are left out."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(order).cast("string")))
    w = Window.partitionBy(key).orderBy(h, order)  # ranks are limited within each task before the shuffle
    return df.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def shortest(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, order, n_chars): of each key the row with the shortest text, of equally short ones the first. Null keys and texts are left out."""
    n = F.length(text).cast("bigint")
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.min_by(order, F.struct(n, order)).alias(order), F.min(n).alias("n_chars"))


def valid_program(slots: Column, steps: Column) -> Column:
    """Whether a program has steps and every operation and type is a known one; a missing type counts as known."""
    kind_ok = lambda c: c.isNull() | F.lower(F.trim(c)).isin(*DTYPES)
    step_ok = F.forall(steps, lambda s: F.coalesce(F.lower(F.trim(s["op"])).isin(*OPS) & kind_ok(s["target_dtype"]), F.lit(False)))
    return F.coalesce((F.size(steps) > 0) & step_ok & F.coalesce(F.forall(slots, lambda s: kind_ok(s["dtype"])), F.lit(True)), F.lit(False))


def without_edges(plans: DataFrame) -> DataFrame:
    """``plans`` (plan_key, calls, final) in which each reference from a call to another is the plan's first quantity instead.

    The first is that of the earliest call, by the name of its slot; a plan without a quantity gets 0. The control that
    shows what the edges are worth: values stay, flow goes.
    """
    entries = "array_sort(transform(filter(map_entries(c.bindings), e -> e.value.source = 'quantity' AND e.value.value IS NOT NULL), e -> named_struct('k', e.key, 'v', e.value.value, 'q', e.value.qid)))"
    p = plans.withColumn("_first", F.expr(f"try_element_at(flatten(transform(filter(calls, c -> c.bindings IS NOT NULL), c -> {entries})), 1)"))
    new = "named_struct('source', 'quantity', 'value', coalesce(_first.v, 0D), 'call_id', CAST(NULL AS STRING), 'dtype', r.dtype, 'qid', _first.q, 'span', r.span, 'entity', r.entity, 'role', r.role)"
    swap = f"transform(calls, c -> named_struct('call_id', c.call_id, 'sub_id', c.sub_id, 'bindings', transform_values(c.bindings, (k, r) -> if(r.source = 'call_output', {new}, r)), 'value_hint', c.value_hint))"
    return p.withColumn("calls", F.expr(swap)).drop("_first")


def plan_json(calls: Column, final: Column) -> Column:
    """A plan as JSON text; fields without a value are left out."""
    return F.to_json(F.struct(calls.alias("calls"), final.alias("final")))


def record_texts(items: DataFrame, variant: str) -> DataFrame:
    """(key, text): training texts of a variant of the data; items: (key, problem, program, calls, final).

    'flat': the program; 'plan': the plan; 'no_edges': the plan without its edges. Rows without a problem, a program or a
    plan are left out.
    """
    ask = {"flat": "Generate an executable JSON program:", "plan": "Generate a dataflow composition plan (JSON):", "no_edges": "Generate a dataflow composition plan (JSON):"}[variant]
    rows = without_edges(items) if variant == "no_edges" else items
    body = F.to_json("program") if variant == "flat" else plan_json(F.col("calls"), F.col("final"))
    has = F.col("program").isNotNull() if variant == "flat" else F.size("calls") > 0
    user = F.concat(F.lit("Problem: "), "problem", F.lit(f"\n\n{ask}"))
    return rows.where(F.col("problem").isNotNull() & has).select("key", F.concat(F.lit("<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"), body, F.lit("<|im_end|>")).alias("text"))


def matches_type(value: Column, kind: Column) -> Column:
    """Whether a text can be a variable of a type: a number only for number types, anything else for the others."""
    number = F.lower(F.trim(kind)).isin("number", "int", "float")
    return F.coalesce(~number | value.try_cast("double").isNotNull(), ~number)


def to_int(value: Column) -> Column:
    """A text as a whole number, without its fraction; 0 where it is none."""
    return F.coalesce(F.when(F.abs(value.try_cast("double")) < 9.2e18, value.try_cast("double")).cast("bigint"), F.lit(0))


def to_float(value: Column) -> Column:
    """A text as a number; 0 where it is none."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))
