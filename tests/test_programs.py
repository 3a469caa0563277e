"""Programs and plans: golden cases, failures, translator against evaluator, rewrites that keep results."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planloom.functions.expr import Unsupported, evaluate, to_sql
from planloom.functions.types import coerce
from planloom.plans.execute import compose, consistency, executed_plans, inlined
from planloom.plans.programs import Program, Slot, Step, executed, output_sql, run, with_program
from planloom.plans.schemas import CALL, PROGRAM, REF

ADD = Program("add", (Slot("a"), Slot("b")), (Step("compute", "s", "a + b"), Step("output", "s", "s")))
MUL = Program("mul", (Slot("a"), Slot("b")), (Step("compute", "p", "a * b"), Step("output", "p", "p")))
LIB = {"L00": ADD, "L01": MUL}


def test_single_programs():
    assert run(ADD, {"a": 3, "b": 5})[:2] == (True, 8.0)
    assert run(MUL, {"a": 4, "b": 7})[:2] == (True, 28.0)
    ok, out, error, _ = run(ADD, {"a": 3})
    assert not ok and out is None and "missing slot b" in error
    two = Program("m", (Slot("a"), Slot("b"), Slot("c")), (Step("compute", "s", "a + b"), Step("compute", "r", "s * c"), Step("output", "r", "r")))
    assert run(two, {"a": 2, "b": 3, "c": 4})[1] == 20
    assert run(Program("n", (Slot("n", "int"),), (Step("output", "r", "n * 2", (), "int"),)), {"n": "5.9"})[1] == 10
    assert run(Program("none", (), (Step("compute", "x", "1"),)), {})[:2] == (True, None)
    assert run(Program("long", (), tuple(Step("compute", "x", "1") for _ in range(101))), {})[0] is False
    ok, _, error, _ = run(Program("bad", (Slot("a"),), (Step("compute", "x", "a / 0"),)), {"a": 1})
    assert not ok and error.startswith("step 0 (x)")


def test_names_hide_constants():
    assert evaluate("e + pi", {"e": 1, "pi": 2}) == 3
    assert to_sql("min + e", {"min": "m", "e": "x"}) == "try_add(m, x)"


def test_names_hide_functions():
    for expr in ("min(a, 2)", "pow(a, 2)"):
        names = {"a": "x", expr[:3]: "y"}
        with pytest.raises(Unsupported):
            to_sql(expr, names)
        with pytest.raises(Unsupported):
            evaluate(expr, {"a": 1, expr[:3]: 3})


LOGIC = ("a and b", "a or b", "not a", "1 if a else 2", "a > 1 and b", "a > 1 or b < 2", "not (a and b)", "(a > 0) + (b > 0)", "(a > 1) == (b > 1)", "True and a", "a and b and 5", "0 or a or 7", "-(a > 0)", "2 if not a else a and b", "divmod(a, 3)[0]", "divmod(7, 3)[1] + a", "pow(3, 5, 7) * a", "max(a > 1, b)", "[a > 1, 2][0]")


def test_truth_values_of_numbers(spark):
    for a, b in ((0.0, 2.0), (3.0, 0.0), (1.5, -1.0)):
        columns = [F.expr(f"CAST({to_sql(e, {'a': f'{a}D', 'b': f'{b}D'})} AS DOUBLE)").alias(f"c{i}") for i, e in enumerate(LOGIC)]
        assert list(spark.range(1).select(*columns).first()) == [float(evaluate(e, {"a": a, "b": b})) for e in LOGIC]
    failing = [f"CAST({to_sql(e, {'a': '0D'})} AS DOUBLE)" for e in ("1 / a and 2", "5 if 1 / a else 6", "1 / a > 0 or True")]
    assert list(spark.range(1).selectExpr(*failing).first()) == [None] * 3


def test_long_programs_have_sql_of_a_length_in_proportion(spark):
    steps = [Step("compute", "t0", "a + b")]
    for i in range(1, 99):
        steps.append(Step("compute", f"t{i}", f"t{i - 1} * 0.5 + t{i - 1} * 0.5 + {i % 3}"))
    p = Program("long", (Slot("a"), Slot("b", "int")), (*steps, Step("output", "t98", "t98")))
    sql = output_sql(p, {"a": "2.5D", "b": "3.9D"})
    assert len(p.steps) == 100 and len(sql) < 400_000
    assert spark.range(1).selectExpr(f"{sql} AS x").first().x == pytest.approx(run(p, {"a": 2.5, "b": 3.9})[1])
    again = Program("again", (Slot("a"),), tuple(Step("compute", "x", "a + x" if i else "a") for i in range(60)) + (Step("output", "x", "x + x * x - x * x"),))
    assert spark.range(1).selectExpr(f"{output_sql(again, {'a': '1D'})} AS x").first().x == 60.0


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "[x for x in a]", "lambda: 1", "f(1)", "a +", "open('x')"])
def test_other_syntax_is_refused(bad):
    with pytest.raises((Unsupported, TypeError)):
        evaluate(bad, {"a": 1})
    with pytest.raises(Unsupported):
        to_sql(bad, {"a": "a"})


def test_coercion():
    assert coerce("3.9", "int") == 3 and coerce(" 1e3 ", "int") == 1000 and coerce("False", "bool") is True and coerce(2, "list[int]") == [2]
    for v, t in (("x", "float"), (math.inf, "int"), (None, "int"), (1, "date")):
        with pytest.raises(ValueError):
            coerce(v, t)


NUMBERS = st.one_of(st.integers(-50, 50), st.floats(-50, 50, allow_nan=False).map(lambda x: round(x, 2)))
EXPRS = st.recursive(
    st.sampled_from(["a", "b", "c", "2", "0.5", "3"]),
    lambda e: st.one_of(
        st.tuples(e, st.sampled_from(["+", "-", "*", "/"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
        st.tuples(st.sampled_from(["min", "max"]), e, e).map(lambda t: f"{t[0]}({t[1]}, {t[2]})"),
        st.tuples(e, st.sampled_from(["<", ">=", "=="]), e, e, e).map(lambda t: f"({t[3]} if {t[0]} {t[1]} {t[2]} else {t[4]})"),
        e.map(lambda x: f"abs({x})"), e.map(lambda x: f"-{x}"),
    ),
    max_leaves=8,
)


@settings(max_examples=60, deadline=None)
@given(expr=EXPRS, a=NUMBERS, b=NUMBERS, c=NUMBERS)
def test_sql_and_values_agree(spark, expr, a, b, c):
    env = {"a": float(a), "b": float(b), "c": float(c)}
    try:
        want = float(evaluate(expr, env))
    except ZeroDivisionError:
        want = None
    got = spark.range(1).select(F.expr(f"CAST({to_sql(expr, {k: f'double({v!r})' for k, v in env.items()})} AS DOUBLE)")).first()[0]
    assert (got is None) == (want is None) and (want is None or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9))


def test_columns_of_a_program(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 4.0, 0.0), (3, None, 1.0)], "id int, x double, y double")
    p = Program("d", (Slot("a"), Slot("b")), (Step("compute", "q", "a / b"), Step("output", "q", "q + 1")))
    got = {r.id: (r.ok, r.output, r.failed_step) for r in with_program(df, p, {"a": "x", "b": "y"}).collect()}
    assert got == {1: (True, 3.0, -1), 2: (False, None, 0), 3: (False, None, -2)}


def test_programs_in_rows(spark):
    add = ("p", [("a", "float", None), ("b", "float", None)], [("compute", "s", "a + b", ["a", "b"], "float"), ("OUTPUT", "s", "s", None, None)], None)
    rows = [(1, add, {"a": 1.0, "b": 2.0}), (2, add, {"a": 1.0}), (3, None, None), (4, add, None), (5, ("p", None, None, None), {}), (6, ("p", [None], [("compute", "x", "1 +", None, None)], None), {})]
    df = spark.createDataFrame(rows, f"id bigint, program {PROGRAM.simpleString()}, bindings map<string,double>")
    got = {r.id: (r.ok, r.result) for r in executed(df, "id").collect()}
    assert got == {1: (True, 3.0), 2: (False, None), 4: (False, None), 5: (True, None), 6: (False, None)}
    assert executed(df.where("id > 99"), "id").count() == 0


def test_calls_inherit_variables():
    assert compose([("L00", {"a": 10, "b": 20})], LIB) == (True, 30.0, 1, None)
    assert compose([("L00", {"a": 2, "b": 3}), ("L01", {"b": 4})], LIB)[1] == 8
    assert not compose([("NONE", {})], LIB)[0]
    assert compose([("L00", {})], LIB, {"a": 100, "b": 200})[1] == 300
    assert compose([("L00", {"a": 1, "b": 2}), ("L01", {"b": 3}), ("L00", {"b": 10})], LIB)[2] == 3
    assert not compose([], LIB)[0]


def ref(source, value=None, call=None, qid=None):
    return (source, value, call, None, qid, None, None, None)


def plans(spark, *rows):
    return spark.createDataFrame(list(rows), f"plan_key bigint, calls array<{CALL.simpleString()}>, final {REF.simpleString()}")


GOOD = [("c0", "L00", {"a": ref("quantity", 2.0, None, "q0"), "b": ref("quantity", 3.0)}, (5.0, None, None)), ("c1", " l01", {"a": ref("call_output", None, "c0"), "b": ref("constant", 4.0)}, (20.0, None, None))]


def test_explicit_plans(spark):
    last = ref("call_output", None, "c1")
    rows = [
        (1, GOOD, last), (2, GOOD, None), (3, [("c0", "L00", {}, None)], None), (4, [("c0", "L00", {"a": ref("constant", 1.0)}, None)], None),
        (5, [("c0", "L00", {"a": ref("call_output", None, "zz"), "b": ref("constant", 1.0)}, None)], None), (6, None, None), (7, [], last), (8, [("c0", None, None, None)], None),
        (9, GOOD, ref("call_output", None, "zz")), (10, GOOD, ref("constant", 7.0)),
    ]
    got = {r.plan_key: (r.ok, r.result) for r in executed_plans(plans(spark, *rows), LIB).collect()}
    assert got == {1: (True, 20.0), 2: (True, 20.0), 10: (True, 7.0)} | {k: (False, None) for k in (3, 4, 5, 6, 7, 8, 9)}
    q = executed_plans(plans(spark, (1, GOOD, last)), LIB, quantities=F.create_map(F.lit("q0"), F.lit(10.0)))
    assert q.first().result == 52.0


def test_hints(spark):
    wrong = [(*GOOD[0][:3], (999.0, None, None))]
    none = [(*GOOD[0][:3], None)]
    got = {r.plan_key: (r.n_hints, r.n_consistent, r.n_errors, r.agreement) for r in consistency(plans(spark, (1, GOOD, None), (2, wrong, None), (3, none, None), (4, None, None)), LIB).collect()}
    assert got == {1: (2, 2, 0, True), 2: (1, 0, 1, False), 3: (0, 0, 0, False), 4: (0, 0, 0, False)}


def test_inlined_program_gives_what_the_calls_give():
    calls = [("L00", {"a": 2, "b": 3}), ("L01", {"b": 4}), ("L00", {"a": 5, "b": 6})]
    program, bindings = inlined(calls, LIB)
    assert run(program, bindings)[1] == compose(calls, LIB)[1] == 11
    assert sum(s.op == "output" for s in program.steps) == 1
    assert inlined([("NONE", {})], LIB) is None
