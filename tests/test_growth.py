"""Audits, growth, search and records on small fixtures: nulls, empty tables, ties, extra columns with clashing names."""

import itertools
import json
import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from planloom.functions.types import coerce
from planloom.operators import audits, growth, records, templates
from planloom.plans.execute import compose
from planloom.plans.programs import Program, Slot, Step, run, sql_function
from planloom.plans.schemas import CALL, PROGRAM, REF
from planloom.sources import files


def prog(name, expr, *slots, dtype="float"):
    return Program(name, tuple(Slot(s, dtype) for s in slots), (Step("compute", "res", expr), Step("output", "res", "res")))


LIB = {"L00": prog("L00", "a + b", "a", "b"), "L01": prog("L01", "a * b", "a", "b"), "L02": prog("L02", "x - 1", "x"), "L03": prog("L03", "a / b", "a", "b")}


def ref(source, value=None, call=None, qid=None):
    return (source, value, call, None, qid, None, None, None)


def plans(spark, *rows):
    return spark.createDataFrame([(*r, True, "s", "clash") for r in rows], f"plan_key bigint, calls array<{CALL.simpleString()}>, final {REF.simpleString()}, success boolean, source string, step string")


def row(p):
    return (p.program_id, [(s.name, s.dtype, None) for s in p.slots], [(s.op, s.target, s.expr, None, "float") for s in p.steps], None)


def library_df(spark):
    return spark.createDataFrame([(k, row(p), 10 * i, 1.0 * i) for i, (k, p) in enumerate(LIB.items())] + [("L99", None, None, None), (None, None, 1, 1.0)], f"sub_id string, program {PROGRAM.simpleString()}, support bigint, mdl_gain double")


def test_where_plans_stop(spark):
    q = lambda v: ref("quantity", v)
    rows = [
        (1, [("c0", " l00 ", {"a": q(1.0), "b": q(2.0)}, None)], None), (2, [("c0", "L00", {"a": q(1.0)}, None)], None), (3, [("c0", "NONE", {}, None)], None), (4, [("c0", "L00", {"a": q(1.0), "b": q(2.0)}, None), ("c1", "L03", {"a": q(1.0), "b": q(0.0)}, None)], None),
        (5, None, None), (6, [], None), (7, [("c0", "L00", {"a": q(1.0), "b": ref("call_output", None, "zz")}, None)], None), (8, [("c0", None, None, None)], None), (9, [("c0", "L00", None, None)], None),
    ]
    got = {r.plan_key: (r.step, r.kind) for r in audits.failure_steps(plans(spark, *rows), library_df(spark), LIB).collect()}
    assert got == {
        1: (-1, "wrong_answer"), 2: (0, "type_mismatch"), 3: (0, "missing_sub"), 4: (1, "execution_error"), 5: (-1, "no_plan"), 6: (-1, "no_plan"), 7: (0, "type_mismatch"), 8: (0, "missing_sub"), 9: (0, "type_mismatch"),
    }
    failed = plans(spark, *rows).withColumn("success", F.col("plan_key") == 1)
    classes = {r.plan_key: r["class"] for r in audits.failure_classes(failed, library_df(spark), LIB).collect()}
    assert classes == {2: "wrong_bindings", 3: "missing_abstraction", 4: "dsl_limitation", 5: "missing_abstraction", 6: "missing_abstraction", 7: "wrong_bindings", 8: "missing_abstraction", 9: "wrong_bindings"}
    assert audits.failure_classes(failed.where("false"), library_df(spark), LIB).count() == 0


def test_classes_of_failures(spark):
    cases = [
        ("no solution found", "mcts", None, None, True, 1, 0, 0, "search_failed"), ("no solution found", "cot", None, None, True, 1, 0, 0, "wrong_abstraction"), ("", "x", "19.9", "20", True, 1, 0, 0, "answer_extraction"),
        ("", "x", "12", "20", True, 1, 0, 0, "wrong_abstraction"), ("", "x", "12 apples", "12 apples left", True, 1, 0, 0, "answer_extraction"), ("", None, None, None, False, 0, 0, 0, "missing_abstraction"),
        ("Unknown subroutine 'L7'", None, None, None, True, 1, 0, 0, "missing_abstraction"), ("Step 1 (x): name 'q' is not defined", None, None, None, True, 2, 0, 0, "dsl_limitation"), ("Cannot bind slot 'a'", None, None, None, True, 1, 0, 0, "wrong_bindings"),
        ("", None, None, None, True, 2, 1, 0, "missing_abstraction"), ("", None, None, None, True, 2, 0, 1, "spurious_subroutine"), ("", None, None, None, True, 3, 0, 1, "wrong_abstraction"), ("Step 1 (x): bad", None, None, None, True, 2, 0, 0, "wrong_order"),
        ("Step 1 (x): bad", None, None, None, True, 1, 0, 0, "dsl_limitation"), ("Max calls exceeded", None, None, None, True, 0, 0, 0, "wrong_order"), (None, None, None, None, None, 0, 0, 0, "missing_abstraction"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, m string, p string, g string, h boolean, n int, u int, c int, want string")
    got = df.select("i", audits.failure_class(*(F.col(x) for x in "empghnuc")).alias("got"), "want").where("got <> want or got is null").collect()
    assert not got


def test_sensitivity_of_values(spark):
    q = lambda v: ref("quantity", v)
    calls = [("c0", "L00", {"a": q(2.0), "b": q(0.0), "unused": q(5.0)}, None), ("c1", "L01", {"a": ref("call_output", None, "c0"), "b": ref("constant", 3.0)}, None)]
    got = [tuple(r) for r in audits.sensitivity(plans(spark, (1, calls, None), (2, None, None), (3, [("c0", "NONE", {"a": q(1.0)}, None)], None)), LIB).collect()]
    assert got == [(1, 4, 2)]


def test_rates_are_null_where_nothing_was_compared(spark):
    q = lambda v: ref("quantity", v)
    r = audits.mechanism_rates(plans(spark, (1, [("c0", "L00", {"a": q(1.0), "b": q(2.0)}, None)], None), (2, None, None)), LIB).first()
    assert (r.n, r.parse_rate, r.exec_rate, r.agreement_rate, r.symbolic_accuracy) == (2, 0.5, 0.5, None, 0.5)
    a = audits.faithful_audit(plans(spark, (1, [("c0", "L00", {"a": q(1.0), "b": q(2.0)}, None)], None), (2, None, None)), LIB).first()
    assert (a.total, a.built, a.executed, a.correct, a.call_counts) == (2, 1, 1, 1, "1:1")


def test_minting(spark):
    new, old = row(prog("n", "a - b", "a", "b"))[2], row(LIB["L01"])[2]
    c = spark.createDataFrame([(new, 4, 7), (old, 5, 1), (new, 1, 9), (row(prog("m", "a - 9", "a"))[2], 2, 3)], f"steps {PROGRAM['steps'].dataType.simpleString()}, support bigint, order bigint")
    got = {r.sub_id: (r.support, r.is_new) for r in growth.minted(library_df(spark), c).collect()}
    assert got == {"L00": (0, False), "L01": (15, False), "L02": (20, False), "L03": (30, False), "L100": (2, True), "L101": (5, True)}
    assert growth.minted(library_df(spark).where("false"), c).where("sub_id = 'L00'").count() == 1
    assert growth.minted(library_df(spark), c.where("false")).count() == 4


def test_chains_have_varying_slots_as_parameters():
    p = growth.chained(["L00", "L02"], LIB, {("L00", "a"): True, ("L00", "b"): False}, {("L00", "b"): 4.0})
    assert [s.name for s in p.slots] == ["L00_a", "x"] and run(p, {"L00_a": 1, "x": 8})[1] == 7.0
    assert growth.chained(["L00", "NONE"], LIB, {}, {}) is None
    assert growth.chained(["L02"], LIB, {("L02", "x"): False}, {("L02", "x"): 1.0}) is None
    good = [({"L00_a": i, "x": i}, i - 1.0) for i in range(12)]
    assert growth.verified(p, good) == (True, 1.0) and growth.verified(p, []) == (False, 0.0) and growth.verified(p, [({}, 1.0)]) == (False, 0.0)
    assert growth.verified(p, good[:7] + [(b, 99.0) for b, _ in good[7:]]) == (False, 0.7)
    grown = growth.evolved([("L00>L02", 9, 1.0), ("L00>L02", 8, 1.0), ("L00>L01", 3, 1.0), ("L00>NONE", 3, 1.0)], LIB, {("L00", "a"): True}, {("L00", "b"): 4.0}, lambda q: good if "L02" in q.program_id else [])
    assert [g["sub_id"] for g in grown] == ["L04", None, None, None]
    assert [g["sub_id"] for g in growth.evolved([("L00>L02", 9, 1.0)], LIB, {("L00", "a"): True}, {}, lambda q: good, max_size=4)] == [None]


def test_calls_for_a_wanted_result_against_brute_force():
    rng = random.Random(5)
    lib = LIB | {"L04": prog("L04", "max(a, b) + 2", "a", "b"), "L05": prog("L05", "a // b", "a", "b", dtype="int"), "L06": Program("L06", (Slot("a"),), (Step("compute", "r", "a"),))}
    close = lambda x, g: abs(x - g) < (1e-3 if g == 0 else 1e-2 * abs(g))
    for _ in range(60):
        values, gold = [float(rng.randint(0, 9)) + rng.choice([0, 0.5]) for _ in range(rng.randint(0, 4))], float(rng.randint(0, 60))
        want = next(((s, list(o)) for s, p in lib.items() for o in itertools.permutations(range(len(values)), len(p.slots)) if isinstance(run(p, {x.name: values[i] for x, i in zip(p.slots, o)})[1], float) and close(run(p, {x.name: values[i] for x, i in zip(p.slots, o)})[1], gold)), None)
        got = growth.one_call(values, gold, lib)
        assert (got and (got[0], got[1])) == want
    for _ in range(25):
        values, gold = [float(rng.randint(1, 9)) for _ in range(3)], float(rng.randint(0, 80))
        want = None
        for (a, p), (b, s) in itertools.product(LIB.items(), LIB.items()):
            for o in itertools.permutations(range(3), len(p.slots)):
                r1 = run(p, {x.name: values[i] for x, i in zip(p.slots, o)})[1]
                rest = [i for i in range(3) if i not in o]
                for at in range(len(s.slots)):
                    for o2 in itertools.permutations(rest, len(s.slots) - 1):
                        given = [values[i] for i in o2]
                        given.insert(at, r1)
                        out = run(s, {x.name: v for x, v in zip(s.slots, given)})[1] if r1 is not None else None
                        want = want or ((a, b) if out is not None and close(out, gold) else None)
        got = growth.two_calls(values, gold, LIB)
        assert (got and got[:2]) == want


def test_repair_finds_a_plan_that_runs(spark):
    broken = [("L00", {"a": 1.0, "b": 2.0}), ("NONE", {"a": 3.0})]
    plan, ok, reward, rounds = growth.repaired(broken, LIB)
    assert ok and rounds == 1 and compose(plan, LIB)[0] and reward > 0.5
    assert growth.repaired([], {})[1] is False
    steps = "array<struct<sub_id:string,bindings:map<string,double>>>"
    df = spark.createDataFrame([(1, [("l00", {"a": 1.0, "b": 2.0})], "x"), (2, [("NONE", None)], "x"), (3, None, "x"), (4, [], "x")], f"plan_key bigint, steps {steps}, plan string")
    got = {r.plan_key: (r.ran, r.runs) for r in growth.repaired_plans(df, LIB).collect()}
    assert got[1] == (True, True) and got[2][0] is False and got[3] == got[4] == (False, False)


def every_change(calls, library, rounds=3, width=4, max_calls=6):
    """What ``repaired`` gives, by running each change of each plan from its start."""

    def reward(plan, safe):
        ok, out, made, _ = compose(plan, library)
        good = bool(ok and isinstance(out, (int, float)) and math.isfinite(out))
        return 0.25 * made + 0.10 * (bool(plan) and made == len(plan)) - 0.05 * len(plan) - 0.10 * (not safe) + 0.20 * bool(good and abs(out) > 1e-6), good

    def safe(program, given):
        try:
            return all(given.get(s.name) is None or [coerce(given[s.name], s.dtype)] for s in program.slots)
        except ValueError:
            return False

    def changes(plan):
        n = len(plan)
        for i, (_, given) in enumerate(plan):
            yield from (([*plan[:i], (o, given), *plan[i + 1 :]], safe(p, given)) for o, p in library.items() if o != plan[i][0])
        env = {k: v for _, given in reversed(plan) for k, v in given.items() if v is not None}
        for i, (sub, given) in enumerate(plan):
            for s in library[sub].slots if sub in library else ():
                yield from (([*plan[:i], (sub, {**given, s.name: v}), *plan[i + 1 :]], True) for k, v in env.items() if k != s.name)
        yield from (([*plan[:i], (o, {}), *plan[i:]], True) for i in range(n + 1) if n < max_calls for o in library)
        yield from (([*plan[:i], *plan[i + 1 :]], True) for i in range(n) if n > 1)

    plan = [((sub or "").strip().upper(), dict(given or {})) for sub, given in calls]
    (score, good), beam = reward(plan, True), [plan]
    best = (score, plan, good)
    for used in range(1, rounds + 1):
        scored = sorted(((*reward(p, ok), p) for b in beam for p, ok in changes(b)), key=lambda x: -x[0])[:width]
        beam = [p for _, _, p in scored]
        if scored and scored[0][0] > best[0]:
            best = (scored[0][0], beam[0], scored[0][1])
        if best[2]:
            return best[1], True, round(best[0], 6), used
    return best[1], best[2], round(best[0], 6), rounds


def random_library(rng, kinds, names, size):
    lib = {}
    for i in range(size):
        slots = rng.sample(names, rng.randint(0 if rng.random() < 0.1 else 1, 3))
        expr = f" {rng.choice('+-*/')} ".join(slots or ["5"]) + rng.choice(["", "", "", " * 1e200", " ** 3"])
        target, kind = rng.choice(["res", "res", "a"]), rng.choice(kinds)
        steps = (Step("compute", target, expr, (), kind), Step("output", target, target, (), kind))
        lib[f"L{i:03d}"] = Program(f"L{i:03d}", tuple(Slot(s, rng.choice(kinds)) for s in slots), steps[: rng.choice([1, 2, 2, 2, 2])])
    return lib


def random_calls(rng, lib, values, n):
    subs = [rng.choice([*lib, "NONE", None]) for _ in range(n)]
    return [(s, {k: rng.choice(values) for k in [*(x.name for x in lib[s].slots), "zz"] if rng.random() < 0.6} if s in lib else None) for s in subs]


@pytest.mark.parametrize(
    "kinds, names, values",
    [
        (["int", "float", "float"], "abcdxy", [0.0, 1.0, 2.0, 3.5, 7.0, 100.0]),
        (["int", "float", "bool"], ["a", "b", "x", "y", "res"], [0.0, 1.0, 3.5, math.inf, math.nan, None, 1e300]),
        (["int", "float", "string", "list[float]", "list[int]", "weird"], ["a", "b", "x", "res", "__h"], [0.0, 2.0, math.inf, math.nan, None]),
    ],
)
def test_repair_against_every_change(kinds, names, values):
    rng = random.Random(3)
    for _ in range(40):
        lib = random_library(rng, kinds, list(names), rng.randint(0, 10))
        calls, options = random_calls(rng, lib, values, rng.randint(0, 7)), rng.choice([{}, {}, {"width": 2}, {"max_calls": 3}])
        assert repr(growth.repaired(calls, lib, **options)) == repr(every_change(calls, lib, **options))


def test_repair_of_plans_with_lists(spark):
    lib = {"L00": Program("L00", (Slot("a", "list[float]"),), (Step("compute", "res", "sum(a)"), Step("output", "res", "res"))), "L01": prog("L01", "x / 0", "x")}
    steps = "array<struct<sub_id:string,bindings:map<string,double>>>"
    df = spark.createDataFrame([(1, [("L00", {"a": 2.0}), ("L01", {"x": 1.0})]), (2, [("NONE", None)])], f"plan_key bigint, steps {steps}")
    got = {r.plan_key: (r.ran, r.plan, r.runs, r.rounds) for r in growth.repaired_plans(df, lib).collect()}
    assert got == {1: (False, "L00>L00", True, 1), 2: (False, "NONE", False, 3)}


def test_repair_runs_few_of_its_changes():
    rng = random.Random(4)
    lib = random_library(rng, ["int", "float"], [f"s{i}" for i in range(16)], 240)
    broken = [random_calls(rng, lib, [1.0, 2.0, 3.5, 7.0], 5) for _ in range(10)]
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(count)
    try:
        for calls in broken:
            growth.repaired(calls, lib)
    finally:
        sys.setprofile(None)
    assert n < 1_000_000  # each plan has thousands of changes a round


def test_scores_of_candidates():
    got = {s: (v, ok) for s, v, ok in growth.candidate_scores(LIB | {"L08": prog("L08", "a / (b - 1)", "a", "b"), "L09": prog("L09", "b", "a", "b")})}
    assert got == {"L00": (1.0, True), "L01": (1.0, True), "L02": (0.8, True), "L03": (1.0, True), "L08": (0.0, False), "L09": (0.8, True)}


def test_best_template_against_brute_force(spark):
    rng = random.Random(6)
    ops, domains = ["add", "sell off", "cut", "mix"], ["trade", "farm", None]
    ts = [(f"T{i}", None, rng.choice(domains), None, [(1, rng.choice(ops), "x", None, "r") for _ in range(rng.randint(0, 3))] or None, rng.choice([None, 1, 2])) for i in range(40)]
    t = spark.createDataFrame(ts, "template_id string, name string, domain string, variables array<struct<name:string,type:string>>, steps array<struct<step_id:int,operation:string,expression:string,inputs:array<string>,output_var:string>>, reuse_count bigint")
    texts = [(i, " ".join(rng.choice(["we", "add", "sell", "off", "trade", "nothing", "farm", "mixed"]) for _ in range(rng.randint(0, 5))), "clash") for i in range(80)] + [(99, None, "clash")]
    want = {}
    for i, text, _ in texts:
        score = lambda x, text=text: sum(w in (text or "") for s in x[4] or [] for w in s[1].split()) + 2 * bool(x[2] and x[2] in (text or ""))
        best = min(ts, key=lambda x: (-score(x), -(x[5] or 0), x[0]))
        if score(best):
            want[i] = (best[0], score(best))
    p = spark.createDataFrame(texts, "k int, problem string, template_id string")
    assert {r.k: (r.template_id, r.score) for r in audits.template_coverage(p, t, "k", "problem").collect()} == want
    assert audits.template_coverage(p, t.where("false"), "k", "problem").count() == 0 == audits.template_coverage(p.where("false"), t, "k", "problem").count()


def test_edges_become_the_first_quantity(spark):
    q = ref("quantity", 5.0, None, "q1")
    rows = [(1, [("c0", "L00", {"b": ref("quantity", 7.0), "a": q}, None), ("c1", "L01", {"a": ref("call_output", None, "c0")}, None)], None), (2, [("c0", "L00", {"a": ref("call_output", None, "zz")}, None), ("c1", None, None, None)], None), (3, None, None)]
    got = {r.plan_key: r.calls for r in records.without_edges(plans(spark, *rows)).collect()}
    a = got[1][1].bindings["a"]
    assert (a.source, a.value, a.qid, a.call_id) == ("quantity", 5.0, "q1", None) and got[2][0].bindings["a"].value == 0.0 and got[3] is None


def test_resumed_extraction(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    seen = []

    def work(part):
        seen.append(part.count())
        return part

    first = files.extracted(df, "id", str(tmp_path / "out"), work, parts=6, stop_after=2)
    assert first.count() == sum(seen) and len(seen) == 2
    again = files.extracted(df, "id", str(tmp_path / "out"), work, parts=6)
    assert len(seen) == 6 and sorted(r.x for r in again.collect()) == [2 * i for i in range(100)]
    files.extracted(df, "id", str(tmp_path / "out"), work, parts=6)
    assert len(seen) == 6


def test_template_bank_files(spark, tmp_path):
    t = spark.createDataFrame([("T1", "n", None, [("x", "int")], [(1, "add", "{x}", ["x"], "r")], None), (None, "n", None, None, None, 1), ("T2", None, "d", None, None, 3)], "template_id string, name string, domain string, variables array<struct<name:string,type:string>>, steps array<struct<step_id:int,operation:string,expression:string,inputs:array<string>,output_var:string>>, reuse_count bigint")
    files.write_templates(t, str(tmp_path / "bank"))
    back = {r.template_id: r for r in files.read_templates(spark, str(tmp_path / "bank")).collect()}
    assert set(back) == {"T1", "T2"} and back["T1"].reuse_count == 0 and back["T1"].steps[0].expression == "{x}" and back["T2"].variables is None
    shared = templates.shared_variables(t.withColumn("domain", F.lit("d")).where("template_id is not null")).collect()
    assert [tuple(r) for r in shared] == [("T1", "T2", "")]


def test_small_records(spark):
    rows = spark.createDataFrame([(0, "3 and 1,000", "x"), (1, "only 5", "x"), (2, None, "x"), (3, ",,, 7. 8", "x")], "i bigint, t string, a string")
    assert [(r.a, r.b, r.result) for r in records.products(rows, "i", "t").orderBy("i").collect()] == [(3.0, 1000.0, 3000.0), (11.0, 17.0, 187.0), (18.0, 28.0, 504.0), (7.0, 8.0, 56.0)]
    d = spark.createDataFrame([("k", 1, "aa"), ("k", 2, "b"), ("k", 3, "b"), (None, 4, ""), ("l", 5, None)], "key string, o int, t string")
    assert [tuple(r) for r in records.shortest(d, "key", "t", "o").collect()] == [("k", 2, 1)]
    assert sorted((r.key, r.rank) for r in records.rows_by_key(d, "key", "o", 2).collect()) == [("k", 1), ("k", 2), ("l", 1)]
    v = spark.createDataFrame([("12.9",), ("x",), (None,), ("1e30",)], "v string")
    assert [tuple(r) for r in v.select(records.to_int(F.col("v")), records.to_float(F.col("v")), records.matches_type(F.col("v"), F.lit("number"))).collect()] == [(12, 12.9, True), (0, 0.0, False), (0, 0.0, False), (0, 1e30, True)]
    steps = spark.createDataFrame([(1, [("Compute", "float")]), (2, [("jump", None)]), (3, []), (4, None), (5, [None])], "i int, s array<struct<op:string,target_dtype:string>>").withColumn("slots", F.lit(None).cast("array<struct<dtype:string>>"))
    assert {r.i: r.ok for r in steps.select("i", records.valid_program(F.col("slots"), F.col("s")).alias("ok")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_programs_as_functions_are_inlined(spark):
    sql_function(spark, "planloom_test", LIB["L03"])
    plan = spark.sql("SELECT planloom_test(id, 2) AS y FROM range(3)")
    assert [r.y for r in plan.collect()] == [0.0, 0.5, 1.0] and "planloom_test" not in plan._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        sql_function(spark, "x; DROP", LIB["L00"])
    assert json.loads(json.dumps(math.inf > 0))
