"""Running plans over a library of programs, beside the data and without a shuffle.

A plan is data, so its calls are folded row by row with ``aggregate``; the library is known when the query is planned
and becomes one CASE over sub_id. NULL is failure. Plans of calls that inherit variables by name run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.columns import once
from planloom.functions.types import coerce
from planloom.plans.programs import Program, of_row, output_sql, run

#: Most programs of a library that is compiled into a query.
MAX_LIBRARY = 4096


def library_of(df: DataFrame) -> dict[str, Program]:
    """The programs of a library by sub_id, spelled in upper case; its size is checked before it is read."""
    rows = df.where("sub_id is not null and program is not null").select(F.upper(F.trim("sub_id")).alias("sub_id"), "program")
    if rows.count() > MAX_LIBRARY:
        raise ValueError(f"a library of more than {MAX_LIBRARY} programs can't be compiled; join it instead")
    return {r.sub_id: of_row(r.program) for r in rows.collect()}


def dispatch(library: dict[str, Program], sub: str, value_of: str) -> str:
    """SQL of a call's output: ``sub`` names the program, ``value_of`` is a format that gives a slot's SQL."""
    branches = []
    for sub_id, program in sorted(library.items()):
        try:
            sql = output_sql(program, {s.name: value_of.format(s.name) for s in program.slots})
        except ValueError:
            continue  # a program outside the expression language fails
        branches.append(f"WHEN '{sub_id}' THEN CAST({sql} AS DOUBLE)")
    return f"CASE {sub} {' '.join(branches)} END" if branches else "CAST(NULL AS DOUBLE)"


def executed_plans(plans: DataFrame, library: dict[str, Program], quantities: Column | None = None, stop: bool = True, keep: tuple[str, ...] = ("plan_key",)) -> DataFrame:
    """``keep``, result, ok, n_calls, calls_made and outputs (ARRAY<STRUCT<call_id, value>>) of plans (calls, final).

    A reference to a call's output takes the last earlier call of that id; a quantity takes the value that
    ``quantities`` (MAP<qid, DOUBLE>) has for its qid, else its own. With ``stop``, nothing after a failed call runs.
    A missing slot, an unknown program or a reference that leads nowhere fails; extra bindings are ignored. The result is
    that of ``final``, without one the last output. Null or empty calls fail.
    """
    q = "map()" if quantities is None else "_q"
    last = "element_at(filter({env}, o -> o.call_id = {id}), -1).value"
    looked_up = f"try_element_at({q}, {{r}}.qid)" if quantities is not None else "CAST(NULL AS DOUBLE)"

    def resolved(r: str, env: str) -> str:
        hits = f"filter({env}, o -> o.call_id = {r}.call_id)"
        return f"CASE {r}.source WHEN 'call_output' THEN if(size({hits}) > 0, element_at({hits}, -1).value, NULL) ELSE coalesce({looked_up.format(r=r)}, {r}.value) END"

    values = f"transform_values(coalesce(c.bindings, map()), (k, r) -> {resolved('r', 'acc.outputs')})"
    value_of = "try_element_at(vals, '{}')"
    body = dispatch(library, "upper(trim(c.sub_id))", value_of)
    guard = "acc.ok" if stop else "true"
    # the values are bound once a call by a fold over a one-element array
    output = f"if({guard}, aggregate(array({values}), CAST(NULL AS DOUBLE), (z, vals) -> {body}), CAST(NULL AS DOUBLE))"
    start = "named_struct('ok', true, 'made', 0, 'outputs', CAST(array() AS array<struct<call_id:string,value:double>>), 'last', CAST(NULL AS DOUBLE))"
    step = (
        f"aggregate(array({output}), acc, (y, v) -> named_struct('ok', acc.ok AND v IS NOT NULL, 'made', acc.made + int(v IS NOT NULL),"
        " 'outputs', concat(acc.outputs, array(named_struct('call_id', c.call_id, 'value', v))), 'last', v))"
    )
    df = plans.withColumn("_q", quantities) if quantities is not None else plans
    df = once(df, _r=F.expr(f"aggregate(calls, {start}, (acc, c) -> {step})"))
    df = df.withColumn("_final", F.expr(f"if(final IS NULL OR final.source IS NULL, _r.last, {resolved('final', '_r.outputs')})"))
    good = F.col("_final").isNotNull() & F.coalesce(F.size("calls") > 0, F.lit(False)) & (F.col("_r.ok") if stop else F.lit(True))
    ok = F.coalesce(good, F.lit(False))
    return df.select(
        *keep,
        F.when(ok, F.col("_final") + F.lit(0.0)).alias("result"),
        ok.alias("ok"),
        F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_calls"),
        F.coalesce("_r.made", F.lit(0)).cast("bigint").alias("calls_made"),
        F.col("_r.outputs").alias("outputs"),
    )


def consistency(plans: DataFrame, library: dict[str, Program], rel: float = 0.01, least: float = 1e-3) -> DataFrame:
    """(plan_key, n_hints, n_consistent, n_errors, agreement): value hints against what the calls give.

    A hint agrees if it differs by less than max(rel * |value|, least). Failed calls don't stop the others; a hint on a
    call without a value counts as present only. agreement: hints were compared and none disagreed.
    """
    done = executed_plans(plans, library, stop=False, keep=("plan_key", "calls"))
    near = f"abs(h.hint - h.value) < greatest({rel} * abs(h.value), {least}D)"
    pairs = "zip_with(calls, outputs, (c, o) -> named_struct('hint', c.value_hint.value, 'value', o.value))"
    df = done.withColumn("_h", F.expr(f"filter({pairs}, h -> h.hint IS NOT NULL)"))
    n = lambda cond: F.coalesce(F.size(F.expr(f"filter(_h, h -> {cond})")), F.lit(0)).cast("bigint")
    both = "h.value IS NOT NULL"
    return df.select(
        "plan_key",
        n("true").alias("n_hints"),
        n(f"{both} AND {near}").alias("n_consistent"),
        n(f"{both} AND NOT ({near})").alias("n_errors"),
        ((n(both) > 0) & (n(f"{both} AND NOT ({near})") == 0)).alias("agreement"),
    )


def perturbed(v: str) -> str:
    """SQL of another value: 1 for 0, else twice the value and seven."""
    return f"CASE WHEN {v} = 0 THEN 1D ELSE {v} * 2 + 7 END"


def active_bindings(plans: DataFrame, library: dict[str, Program]) -> DataFrame:
    """(plan_key, slot, call_pos, kind, active): whether a changed quantity or a redirected edge changes the result.

    Each quantity and constant is perturbed on its own; each reference to a call is replaced by the first other earlier
    call's value, else by constant 0. A failure of the changed plan counts as a change. Plans that fail give no rows.
    """
    base = executed_plans(plans, library, keep=("plan_key", "calls", "final")).where("ok").select("plan_key", "calls", "final", F.col("result").alias("_base"))
    calls = base.select("*", F.posexplode("calls").alias("call_pos", "_c"))
    refs = calls.select("plan_key", "calls", "final", "_base", "call_pos", F.explode("_c.bindings").alias("slot", "_ref"))
    kind = F.when(F.col("_ref.source") == "call_output", "edge").otherwise("quantity")
    other = "element_at(filter(slice(calls, 1, call_pos), p -> p.call_id IS NOT NULL AND p.call_id <> _ref.call_id), 1).call_id"
    fallback = "named_struct('source', 'constant', 'value', 0D, 'call_id', CAST(NULL AS STRING), 'dtype', _ref.dtype, 'qid', CAST(NULL AS STRING), 'span', _ref.span, 'entity', _ref.entity, 'role', _ref.role)"
    moved = "named_struct('source', 'call_output', 'value', CAST(NULL AS DOUBLE), 'call_id', {o}, 'dtype', _ref.dtype, 'qid', CAST(NULL AS STRING), 'span', _ref.span, 'entity', _ref.entity, 'role', _ref.role)"
    changed = f"named_struct('source', _ref.source, 'value', {perturbed('_ref.value')}, 'call_id', CAST(NULL AS STRING), 'dtype', _ref.dtype, 'qid', CAST(NULL AS STRING), 'span', _ref.span, 'entity', _ref.entity, 'role', _ref.role)"
    has_other = f"exists(slice(calls, 1, call_pos), p -> p.call_id IS NOT NULL AND p.call_id <> _ref.call_id)"
    new = f"CASE WHEN _ref.source <> 'call_output' THEN {changed} WHEN {has_other} THEN {moved.format(o=other)} ELSE {fallback} END"
    variant = refs.withColumns({"kind": kind, "_new": F.expr(new)}).withColumn(
        "calls",
        F.expr(
            "transform(calls, (c, i) -> if(i = call_pos, named_struct('call_id', c.call_id, 'sub_id', c.sub_id,"
            " 'bindings', transform_values(c.bindings, (k, r) -> if(k = slot, _new, r)), 'value_hint', c.value_hint), c))"
        ),
    )
    again = executed_plans(variant, library, keep=("plan_key", "slot", "call_pos", "kind", "_base"))
    return again.select("plan_key", "slot", F.col("call_pos").cast("bigint").alias("call_pos"), "kind", (~F.col("ok") | (F.abs(F.col("result") - F.col("_base")) > 1e-6)).alias("active"))


def compose(calls: list, library: dict[str, Program], initial: dict | None = None) -> tuple[bool, float | None, int, str | None]:
    """(ok, result, calls that succeeded, error) of calls (sub_id, bindings) that inherit variables.

    A slot takes its explicit binding, else the variable of its name, else the only variable that can be of its type;
    with several there is no way to tell and the call fails. Later calls see every variable of earlier ones.
    """
    env = dict(initial or {})
    out, made = None, 0
    for sub_id, given in calls:
        program = library.get((sub_id or "").strip().upper())
        if program is None:
            return False, None, made, f"unknown program {sub_id}"
        values = {}
        for slot in program.slots:
            if (given or {}).get(slot.name) is not None:
                values[slot.name] = given[slot.name]
            elif env.get(slot.name) is not None:
                values[slot.name] = env[slot.name]
            else:
                fits = list(fitting(env, slot.dtype))
                if len(fits) != 1:
                    return False, None, made, f"slot {slot.name} has {len(fits)} candidates"
                values[slot.name] = fits[0]
        ok, out, error, inner = run(program, values)
        if not ok:
            return False, None, made, error
        made += 1
        env |= inner
        env["__last_output__"] = out
    return made > 0, out, made, None if made else "no calls"


def fitting(env: dict, dtype: str) -> Iterator:
    """The variables that can be of a type."""
    return (v for k, v in env.items() if not k.startswith("__") and _fits(v, dtype))


def _fits(value, dtype: str) -> bool:
    if type(value) is float and dtype == "float":
        return True
    try:
        coerce(value, dtype)
    except ValueError:
        return False
    return True


def composed_plans(plans: DataFrame, library: dict[str, Program]) -> DataFrame:
    """(plan_key, ok, result, calls_made, error) of plans (plan_key, steps ARRAY<STRUCT<sub_id, bindings MAP<STRING, DOUBLE>>>)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for key, steps in zip(b["plan_key"], b["steps"]):
                calls = [(s["sub_id"], dict(s["bindings"]) if s["bindings"] is not None else {}) for s in (steps if steps is not None else []) if s is not None]
                ok, out, made, error = compose(calls, library)
                number = isinstance(out, (int, float))
                rows.append((key, ok, float(out) if number else None, made, error))
            yield pd.DataFrame(rows, columns=["plan_key", "ok", "result", "calls_made", "error"]).astype({"result": "float64"})

    return plans.select("plan_key", "steps").mapInPandas(batches, "plan_key bigint, ok boolean, result double, calls_made bigint, error string")


def inlined(calls: list[tuple[str, dict]], library: dict[str, Program], per_call: bool = True) -> tuple[Program, dict] | None:
    """One program and its bindings that give what the calls give; None if a program is unknown.

    With ``per_call`` every slot is renamed by its call, so bindings of one name in two calls stay apart; without, calls
    share slots of a name and the last binding holds. Only the last output step stays an output.
    """
    import ast

    from planloom.functions.expr import parsed
    from planloom.plans.programs import Slot, Step

    class Rename(ast.NodeTransformer):
        def __init__(self, to: dict[str, str]):
            self.to = to

        def visit_Name(self, n: ast.Name) -> ast.Name:
            return ast.copy_location(ast.Name(self.to.get(n.id, n.id), n.ctx), n)

    slots, steps, bindings, seen = [], [], {}, {}
    for i, (sub_id, given) in enumerate(calls):
        program = library.get((sub_id or "").strip().upper())
        if program is None:
            return None
        names: dict[str, str] = {}
        for s in program.slots:
            explicit = (given or {}).get(s.name) is not None
            if not explicit and s.name in seen:
                names[s.name] = seen[s.name]
                continue
            names[s.name] = f"c{i}_{s.name}" if per_call else s.name
            if names[s.name] not in {x.name for x in slots}:
                slots.append(Slot(names[s.name], s.dtype))
            if explicit:
                bindings[names[s.name]] = given[s.name]
        for step in program.steps:
            text = ast.unparse(Rename(names).visit(ast.fix_missing_locations(ast.parse(ast.unparse(parsed(step.expr)), mode="eval").body)))
            names[step.target] = f"c{i}_{step.target}"
            steps.append(Step(step.op, names[step.target], text, (), step.target_dtype))
        seen |= names
    outputs = [k for k, s in enumerate(steps) if s.op == "output"]
    steps = [Step("compute" if s.op == "output" and k != outputs[-1] else s.op, s.target, s.expr, s.inputs, s.target_dtype) for k, s in enumerate(steps)]
    return Program("inlined", tuple(slots), tuple(steps)), bindings
