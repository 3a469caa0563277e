"""Programs: typed slots and ordered steps. Known ones compile to columns, ones that are rows run in Arrow batches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.expr import Unsupported, evaluate, to_sql
from planloom.functions.types import coerce, coerce_sql
from planloom.operators.nested import json_variant
from planloom.plans.schemas import SLOT, STEP

#: Most steps of a program (fixed value).
MAX_STEPS = 100


@dataclass(frozen=True)
class Slot:
    name: str
    dtype: str = "float"
    description: str | None = None


@dataclass(frozen=True)
class Step:
    op: str
    target: str
    expr: str
    inputs: tuple[str, ...] = ()
    target_dtype: str = "float"


@dataclass(frozen=True)
class Program:
    program_id: str
    slots: tuple[Slot, ...] = ()
    steps: tuple[Step, ...] = ()
    source: str | None = None
    extra: dict = field(default_factory=dict, compare=False)


def _items(x) -> list:
    return [] if x is None else [i for i in x if i is not None]


def of_row(p) -> Program | None:
    """A ``Program`` of a struct row or dict; None for null."""
    if p is None:
        return None
    p = p.asDict(recursive=True) if hasattr(p, "asDict") else p
    slots = tuple(Slot(s["name"], s.get("dtype") or "float", s.get("description")) for s in _items(p.get("slots")))
    steps = tuple(Step((s.get("op") or "compute").lower(), s["target"], s["expr"], tuple(_items(s.get("inputs"))), s.get("target_dtype") or "float") for s in _items(p.get("steps")))
    return Program(p.get("program_id"), slots, steps, p.get("source"))


def compiled(program: Program, bindings: dict[str, str]) -> dict[str, str]:
    """SQL of each target of a program, in its steps' order, and of ``__output__``: a failed or missing value is NULL.

    bindings: SQL of each slot. A slot without one is missing: every later value is NULL. Of several output steps the
    last counts; without one the output is NULL though the program succeeds. Too many steps: all NULL.
    """
    names = {s.name: coerce_sql(bindings[s.name], s.dtype) if s.name in bindings else "CAST(NULL AS DOUBLE)" for s in program.slots}
    out: dict[str, str] = {}
    output = "CAST(NULL AS DOUBLE)"
    for step in program.steps:
        sql = coerce_sql(to_sql(step.expr, names), step.target_dtype)
        names[step.target] = out[step.target] = sql
        if step.op == "output":
            output = sql
    if len(program.steps) > MAX_STEPS:
        out = {k: "CAST(NULL AS DOUBLE)" for k in out}
        output = "CAST(NULL AS DOUBLE)"
    return out | {"__output__": output}


#: A program's SQL is pasted together up to this length; a longer one binds each step's value once.
PASTED = 4000


def output_sql(program: Program, bindings: dict[str, str]) -> str:
    """SQL of a program's output, as ``compiled`` gives it, but of a length in proportion to the program's.

    Where pasting each target into the steps that use it grows beyond ``PASTED``, the steps are a fold over their numbers
    that appends each value to an array of doubles, so it is made once and neither length nor depth grows with its uses.
    Texts and lists have no place there: such a program is ``Unsupported``.
    """
    if len(program.steps) > MAX_STEPS:
        return "CAST(NULL AS DOUBLE)"
    names = {s.name: coerce_sql(bindings[s.name], s.dtype) if s.name in bindings else "CAST(NULL AS DOUBLE)" for s in program.slots}
    inputs, output, fits = dict(names), "CAST(NULL AS DOUBLE)", True
    for step in program.steps:
        sql = coerce_sql(to_sql(step.expr, names), step.target_dtype)
        if len(sql) > PASTED:
            fits = False
            break
        names[step.target] = sql
        if step.op == "output":
            output = sql
    if fits:
        return output
    if any(t.strip().lower() not in ("int", "float", "bool") for t in (*(s.dtype for s in program.slots), *(s.target_dtype for s in program.steps))):
        raise Unsupported("a long program of texts or lists")
    at = {n: i for i, n in enumerate(inputs)}
    cases, last = [], None
    for i, step in enumerate(program.steps):
        value = coerce_sql(to_sql(step.expr, {n: f"e[{k}]" for n, k in at.items()}), step.target_dtype)
        cases.append(f"WHEN {i} THEN CAST({value} AS DOUBLE)")
        at[step.target] = len(inputs) + i
        last = at[step.target] if step.op == "output" else last
    start = ", ".join(f"CAST({sql} AS DOUBLE)" for sql in inputs.values())
    if last is None:
        return output
    return f"aggregate(sequence(0, {len(cases) - 1}), CAST(array({start}) AS array<double>), (e, i) -> concat(e, array(CASE i {' '.join(cases)} END)), e -> e[{last}])"


def sql_function(spark, name: str, program: Program) -> None:
    """Register a program as a temporary SQL function of its slots, as doubles; its body is SQL, so calls of it are inlined."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"no name of a function: {name}")
    args = {s.name: f"a{i}" for i, s in enumerate(program.slots)}
    body = output_sql(program, args)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} DOUBLE' for a in args.values())}) RETURNS DOUBLE RETURN CAST({body} AS DOUBLE)")


def with_program(df: DataFrame, program: Program, bindings: dict[str, str], prefix: str = "") -> DataFrame:
    """``df`` with a column per target, ``<prefix>output``, ``<prefix>ok`` and ``<prefix>failed_step`` (-1 if none failed).

    Steps are chained projections, which Catalyst collapses into one; columns stay in whole-stage code.
    """
    values = dict(bindings)
    names: dict[str, str] = {}
    for s in program.slots:
        df = df.withColumn(f"{prefix}{s.name}_in", F.expr(coerce_sql(values[s.name], s.dtype) if s.name in values else "CAST(NULL AS DOUBLE)"))
        names[s.name] = f"`{prefix}{s.name}_in`"
    missing = F.expr(" OR ".join([f"{names[s.name]} IS NULL" for s in program.slots]) or "false")
    output, failed = F.lit(None).cast("double"), F.when(missing, F.lit(-2))
    for i, step in enumerate(program.steps):
        col = f"{prefix}s{i}"
        df = df.withColumn(col, F.expr(coerce_sql(to_sql(step.expr, names), step.target_dtype)))
        names[step.target] = f"`{col}`"
        failed = failed.when(F.col(col).isNull(), F.lit(i))
        if step.op == "output":
            output = F.col(col).cast("double")
    failed = failed.otherwise(F.lit(-1))
    if len(program.steps) > MAX_STEPS:
        failed = F.lit(MAX_STEPS)
    last = {s.target: f"{prefix}s{i}" for i, s in enumerate(program.steps)}
    targets = [F.col(c).alias(f"{prefix}{t}") for t, c in last.items()]
    inner = [c for c in df.columns if not (c.startswith(f"{prefix}s") and c[len(prefix) + 1 :].isdigit()) and not any(c == f"{prefix}{s.name}_in" for s in program.slots)]
    return df.select(*inner, *targets, failed.alias(f"{prefix}failed_step"), F.when(failed == -1, output).alias(f"{prefix}output"), (failed == -1).alias(f"{prefix}ok"))


def run(program: Program, bindings: dict) -> tuple[bool, object, str | None, dict]:
    """(ok, output, error, env) of one program; the error names the missing slot or the failed step."""
    env: dict = {}
    for s in program.slots:
        if bindings.get(s.name) is None:
            return False, None, f"missing slot {s.name}", {}
        try:
            env[s.name] = coerce(bindings[s.name], s.dtype)
        except ValueError as x:
            return False, None, f"slot {s.name}: {x}", {}
    if len(program.steps) > MAX_STEPS:
        return False, None, f"more than {MAX_STEPS} steps", env
    output = None
    for i, step in enumerate(program.steps):
        try:
            env[step.target] = coerce(evaluate(step.expr, env), step.target_dtype)
        except Exception as x:  # noqa: BLE001 - any failure of a step is a failure of the program
            return False, None, f"step {i} ({step.target}): {x}", env
        if step.op == "output":
            output = env[step.target]
    return True, output, None, env


def executed(df: DataFrame, key: str, program: str = "program", bindings: str = "bindings") -> DataFrame:
    """(key, ok, result, error) of programs that are rows, each with its own bindings; a null program gives no row.

    Programs run in Arrow batches beside the data, without a shuffle. A result that is no number is null.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for k, p, given in zip(b[key], b["p"], b["b"]):
                try:
                    ok, out, error, _ = run(of_row(p), dict(given) if given is not None else {})
                except Exception as x:  # noqa: BLE001 - a malformed program
                    ok, out, error = False, None, str(x)
                number = isinstance(out, (int, float)) and not (isinstance(out, float) and math.isnan(out))
                rows.append((k, ok, float(out) if number else None, error))
            yield pd.DataFrame(rows, columns=[key, "ok", "result", "error"]).astype({"result": "float64"})

    kind = dict(df.dtypes)[key]
    return df.where(F.col(program).isNotNull()).select(key, F.col(program).alias("p"), F.col(bindings).alias("b")).mapInPandas(batches, f"{key} {kind}, ok boolean, result double, error string")


def parsed_programs(programs: DataFrame) -> DataFrame:
    """``programs`` with slots and steps of the typed program, or where a row has none, of the JSON text in ``output``."""
    v = json_variant(F.col("output"))
    typed = F.col("slots").isNotNull() | F.col("steps").isNotNull()
    text_slots = F.try_variant_get(v, "$.slots", f"array<{SLOT.simpleString()}>")
    text_steps = F.try_variant_get(v, "$.steps", f"array<{STEP.simpleString()}>")
    return programs.withColumns({"slots": F.when(typed, F.col("slots")).otherwise(text_slots), "steps": F.when(typed, F.col("steps")).otherwise(text_steps)})


def fingerprint(steps: Column, op: str = "op", expr: str = "expr") -> Column:
    """The first 12 hex digits of the MD5 of ``op:expr`` joined by '|'."""
    return F.substring(F.md5(F.array_join(F.transform(steps, lambda s: F.concat(s[op], F.lit(":"), s[expr])), "|")), 1, 12)


def signature(name: Column, slots: Column) -> Column:
    """``name(slot: type, ...)``."""
    return F.concat(name, F.lit("("), F.array_join(F.transform(slots, lambda s: F.concat(s["name"], F.lit(": "), s["dtype"])), ", "), F.lit(")"))


#: Operator tokens of a step's signature (fixed values).
TOKENS = ("+", "-", "*", "/", "**", "//", "%", "min(", "max(", "abs(", "round(", "sum(", "len(", "sqrt(", "ceil(", "floor(")
#: Those of the signature by which whole programs are mined (fixed values).
MINING_TOKENS = tuple(t for t in TOKENS if t not in ("//", "%"))


def step_signature(op: Column, expr: Column, tokens: tuple[str, ...] = TOKENS) -> Column:
    """``op:`` and the operator tokens that occur in the expression, sorted and joined by '|'."""
    hits = F.array_compact(F.array(*(F.when(F.contains(expr, F.lit(t)), F.lit(t.rstrip("("))) for t in tokens)))
    return F.concat(F.lower(op), F.lit(":"), F.array_join(F.array_sort(hits), "|"))
