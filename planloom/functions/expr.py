"""Step expressions (a subset of Python's) as Spark SQL text, and as values in a task.

``to_sql`` serves programs that are known when the query is planned: they become columns that Catalyst optimises.
``evaluate`` serves programs that are themselves rows. Both take the same whitelist of syntax and neither runs code.

Spark's NULL is the failure of a step: division by zero, a root of a negative, an overflow. Names of slots and targets
hide constants and functions of the same name: a call of such a name fails.
"""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable
from functools import lru_cache

#: Names of the expression language besides slots and targets (fixed values).
CONSTANTS = {"pi": math.pi, "e": math.e, "inf": math.inf, "True": True, "False": False}
FUNCTIONS = (
    "abs", "round", "min", "max", "sum", "len", "int", "float", "bool", "str", "divmod", "pow", "sqrt", "log", "log2", "log10", "exp",
    "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "ceil", "floor", "factorial", "comb", "perm", "gcd",
)


class Unsupported(ValueError):
    """Syntax or a name outside the expression language."""


@lru_cache(maxsize=50_000)
def parsed(expr: str) -> ast.expr:
    try:
        return ast.parse(expr.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as x:
        raise Unsupported(str(x)) from x


# --- as Spark SQL -------------------------------------------------------------------------------------------------


def _finite(sql: str) -> str:
    return f"nullif(nullif(nullif({sql}, double('NaN')), double('inf')), double('-inf'))"


def _floor_div(a: str, b: str) -> str:
    return f"floor(try_divide(double({a}), {b}))"


_BINARY = {
    ast.Add: lambda a, b: f"try_add({a}, {b})",
    ast.Sub: lambda a, b: f"try_subtract({a}, {b})",
    ast.Mult: lambda a, b: f"try_multiply({a}, {b})",
    ast.Div: lambda a, b: f"try_divide(double({a}), {b})",
    ast.FloorDiv: _floor_div,
    ast.Mod: lambda a, b: f"(({a}) - ({b}) * {_floor_div(a, b)})",
    ast.Pow: lambda a, b: _finite(f"pow({a}, {b})"),
}
_COMPARE = {ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_GCD = "aggregate(sequence(1, 93), named_struct('a', abs(bigint({0})), 'b', abs(bigint({1}))), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
_FALLING = "aggregate(if({1} < 1, array(), sequence(1, bigint({1}))), 1D, (p, i) -> {2}, p -> if({1} < 0 OR {1} > {0}, 0D, p))"
_ONE = {
    "abs": "abs({0})", "int": "bigint({0})", "float": "double({0})", "str": "string({0})",
    "sqrt": "if({0} < 0, NULL, sqrt({0}))", "exp": _finite("exp({0})"), "log2": "log2({0})", "log10": "log10({0})",
    "sin": "sin({0})", "cos": "cos({0})", "tan": "tan({0})", "atan": "atan({0})",
    "asin": "if(abs({0}) > 1, NULL, asin({0}))", "acos": "if(abs({0}) > 1, NULL, acos({0}))",
    "ceil": "ceil({0})", "floor": "floor({0})", "factorial": "factorial(int({0}))",
}


def to_sql(expr: str, names: dict[str, str]) -> str:
    """``expr`` as Spark SQL; ``names`` gives the SQL of each slot and target. Raises ``Unsupported``."""
    return _sql(parsed(expr), names)


def _is_truth(n: ast.expr) -> bool:
    """Whether an expression is a truth value by its syntax; others are numbers (or texts or lists)."""
    if isinstance(n, ast.BoolOp):
        return all(map(_is_truth, n.values))
    if isinstance(n, ast.IfExp):
        return _is_truth(n.body) and _is_truth(n.orelse)
    if isinstance(n, ast.Call):
        return isinstance(n.func, ast.Name) and n.func.id == "bool"
    return isinstance(n, ast.Compare) or (isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not)) or (isinstance(n, ast.Constant) and isinstance(n.value, bool)) or (isinstance(n, ast.Name) and n.id in ("True", "False"))


def _sql(n: ast.expr, names: dict[str, str]) -> str:
    go = lambda x: _sql(x, names)
    number = lambda x: f"bigint({go(x)})" if _is_truth(x) and not (isinstance(x, ast.Name) and x.id in names) else go(x)
    truth = lambda x: go(x) if _is_truth(x) and not (isinstance(x, ast.Name) and x.id in names) else f"(try_cast({go(x)} AS DOUBLE) <> 0)"
    if isinstance(n, ast.Name):
        if n.id in names:
            return names[n.id]
        if n.id in ("pi", "e"):
            return f"{n.id}()"
        if n.id == "inf":
            return "double('inf')"
        if n.id in ("True", "False"):
            return n.id.lower()
        raise Unsupported(f"unknown name {n.id}")
    if isinstance(n, ast.Constant):
        if isinstance(n.value, bool):
            return str(n.value).lower()
        if isinstance(n.value, int):
            return f"{n.value}L" if abs(n.value) < 2**63 else f"double('{n.value}')"
        if isinstance(n.value, float):
            return f"double('{n.value!r}')"
        if isinstance(n.value, str):
            return "'" + n.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        raise Unsupported(f"constant {n.value!r}")
    if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
        return _BINARY[type(n.op)](number(n.left), number(n.right))
    if isinstance(n, ast.UnaryOp):
        if isinstance(n.op, ast.Not):
            return f"(NOT {truth(n.operand)})"
        return f"(-{number(n.operand)})" if isinstance(n.op, ast.USub) else number(n.operand)
    if isinstance(n, ast.BoolOp):
        # an operand decides, or the next one is the value; the failure of one that is looked at is the failure of all
        value = go if _is_truth(n) else number
        out = value(n.values[-1])
        for x in reversed(n.values[:-1]):
            stay, go_on = (f"NOT {truth(x)}", truth(x)) if isinstance(n.op, ast.And) else (truth(x), f"NOT {truth(x)}")
            out = f"(CASE WHEN {go_on} THEN {out} WHEN {stay} THEN {value(x)} END)"
        return out
    if isinstance(n, ast.Compare) and all(type(o) in _COMPARE for o in n.ops):
        all_ = (n.left, *n.comparators)
        sides = list(map(go if all(map(_is_truth, all_)) else number, all_))
        return "(" + " AND ".join(f"{a} {_COMPARE[type(o)]} {b}" for a, o, b in zip(sides, n.ops, sides[1:])) + ")"
    if isinstance(n, ast.IfExp):
        value = go if _is_truth(n) else number
        return f"(CASE WHEN {truth(n.test)} THEN {value(n.body)} WHEN NOT {truth(n.test)} THEN {value(n.orelse)} END)"
    if isinstance(n, (ast.List, ast.Tuple)):
        return f"array({', '.join(map(number, n.elts))})"
    if isinstance(n, ast.Subscript):
        at = go(n.slice)
        return f"try_element_at({go(n.value)}, int({at} + if({at} < 0, 0, 1)))"
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
        if n.func.id in names:
            raise Unsupported(f"{n.func.id} is a value here")
        return _call(n.func.id, n.args, [number(a) for a in n.args])
    raise Unsupported(type(n).__name__)


#: a ** b modulo c for whole numbers, c positive and within 31 bits, b not negative, by squaring.
_POWER_MOD = (
    "if({2} <= 0 OR {2} > 2147483647 OR {1} < 0, NULL, aggregate(sequence(0, 62), named_struct('r', 1L % bigint({2}), 'x', pmod(bigint({0}), bigint({2}))), (s, i) ->"
    " named_struct('r', if(getbit(bigint({1}), i) = 1, s.r * s.x % bigint({2}), s.r), 'x', s.x * s.x % bigint({2})), s -> s.r))"
)


def _call(f: str, nodes: list[ast.expr], a: list[str]) -> str:
    listed = len(nodes) == 1 and isinstance(nodes[0], (ast.List, ast.Tuple))
    if f == "bool" and len(a) == 1:
        return f"(try_cast({a[0]} AS DOUBLE) <> 0)"
    if f in _ONE and len(a) == 1:
        return _ONE[f].format(*a)
    if f == "round" and len(a) in (1, 2):
        return f"bround(double({a[0]}), {int(ast.literal_eval(nodes[1])) if len(a) == 2 else 0})"
    if f in ("min", "max") and a:
        if len(a) == 1:
            return f"array_{f}({a[0]})"
        return f"CASE WHEN {' OR '.join(f'{x} IS NULL' for x in a)} THEN NULL ELSE {'least' if f == 'min' else 'greatest'}({', '.join(a)}) END"
    if f == "sum" and len(a) == 1:
        return f"aggregate({a[0]}, 0D, (s, x) -> s + x)"
    if f == "len" and len(a) == 1:
        return f"size({a[0]})" if listed else f"length({a[0]})"
    if f == "divmod" and len(a) == 2:
        return f"array(double({_floor_div(*a)}), double({_BINARY[ast.Mod](*a)}))"
    if f == "pow" and len(a) == 2:
        return _finite(f"pow({a[0]}, {a[1]})")
    if f == "pow" and len(a) == 3:
        return _POWER_MOD.format(*a)
    if f == "log" and len(a) in (1, 2):
        return f"ln({a[0]})" if len(a) == 1 else f"try_divide(ln({a[0]}), ln({a[1]}))"
    if f == "atan2" and len(a) == 2:
        return f"atan2({a[0]}, {a[1]})"
    if f == "comb" and len(a) == 2:
        return _FALLING.format(a[0], a[1], f"p * ({a[0]} - i + 1) / i")
    if f == "perm" and len(a) == 2:
        return _FALLING.format(a[0], a[1], f"p * ({a[0]} - i + 1)")
    if f == "gcd" and len(a) >= 1:
        out = f"abs(bigint({a[0]}))"
        for x in a[1:]:
            out = _GCD.format(out, x)
        return out
    raise Unsupported(f"{f} with {len(a)} arguments")


# --- as values ----------------------------------------------------------------------------------------------------

_OPS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod, ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}
_SAFE: dict[str, Callable] = {n: getattr(math, n) for n in FUNCTIONS if hasattr(math, n) and n != "pow"} | {
    "abs": abs, "round": round, "min": min, "max": max, "sum": sum, "len": len, "int": int, "float": float, "bool": bool, "str": str, "divmod": divmod,
}


def _power(a, b):
    if isinstance(a, int) and isinstance(b, int) and abs(a) > 1 and b * a.bit_length() > 4096:
        raise OverflowError("power too large")
    return a**b


def evaluate(expr: str, env: dict):
    """The value of ``expr`` where names have the values of ``env``. Raises on any failure."""
    return _value(parsed(expr), env)


def _value(n: ast.expr, env: dict):
    go = lambda x: _value(x, env)
    if isinstance(n, ast.Name):
        if n.id in env:
            return env[n.id]
        if n.id in CONSTANTS:
            return CONSTANTS[n.id]
        raise Unsupported(f"unknown name {n.id}")
    if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str)):
        return n.value
    if isinstance(n, ast.BinOp):
        if isinstance(n.op, ast.Pow):
            return _power(go(n.left), go(n.right))
        if type(n.op) in _OPS:
            return _OPS[type(n.op)](go(n.left), go(n.right))
    if isinstance(n, ast.UnaryOp):
        x = go(n.operand)
        return (not x) if isinstance(n.op, ast.Not) else -x if isinstance(n.op, ast.USub) else x
    if isinstance(n, ast.BoolOp):
        stop = isinstance(n.op, ast.Or)
        for v in n.values[:-1]:
            x = go(v)
            if bool(x) == stop:
                return x
        return go(n.values[-1])
    if isinstance(n, ast.Compare):
        left = go(n.left)
        for o, c in zip(n.ops, n.comparators):
            right = go(c)
            if type(o) not in _OPS or not _OPS[type(o)](left, right):
                return False
            left = right
        return True
    if isinstance(n, ast.IfExp):
        return go(n.body) if go(n.test) else go(n.orelse)
    if isinstance(n, (ast.List, ast.Tuple)):
        return [go(x) for x in n.elts]
    if isinstance(n, ast.Subscript):
        return go(n.value)[go(n.slice)]
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
        if n.func.id in env:
            raise Unsupported(f"{n.func.id} is a value here")
        args = [go(a) for a in n.args]
        if n.func.id == "pow" and len(args) == 2:
            return _power(*args)
        if n.func.id == "pow" and len(args) == 3 and all(isinstance(x, int) for x in args) and args[1] >= 0 and args[2] > 0:
            return pow(*args)
        if n.func.id in _SAFE:
            if n.func.id in ("factorial", "comb", "perm") and max(map(abs, args), default=0) > 1000:
                raise OverflowError(n.func.id)
            return _SAFE[n.func.id](*args)
    raise Unsupported(type(n).__name__)
