"""A library that grows: programs minted from what plans do, checked on held-out rows; bindings searched for a wanted result."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.expr import evaluate
from planloom.functions.types import DTYPES, coerce
from planloom.plans.execute import compose, fitting
from planloom.plans.programs import MAX_STEPS, Program, Slot, Step, fingerprint, run

#: Most orders of values that are tried for a call, and for each of two calls (fixed values).
ONE_CALL, FIRST_CALL, SECOND_CALL = 2000, 200, 100


def minted(library: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sub_id, fingerprint, support, is_new): a library with candidates (steps, support, order) added.

    A candidate whose program is in the library adds its support to the first entry with it; others get the next free
    numbers, in their order. Candidates of one program count as one. Their number is that of a library's entries.
    """
    fp = lambda c: fingerprint(F.col(c))
    lib = library.where("sub_id is not null and program is not null").select("sub_id", fp("program.steps").alias("fingerprint"), F.coalesce("support", F.lit(0)).alias("support"))
    holder = lib.groupBy("fingerprint").agg(F.min("sub_id").alias("sub_id"))
    c = candidates.select(fp("steps").alias("fingerprint"), "support", "order").groupBy("fingerprint").agg(F.sum("support").alias("more"), F.min("order").alias("order"))
    known = c.join(holder, "fingerprint").select("sub_id", "more")
    old = lib.join(known, "sub_id", "left").select("sub_id", "fingerprint", (F.col("support") + F.coalesce("more", F.lit(0))).alias("support"), F.lit(False).alias("is_new"))
    number = F.when(F.col("sub_id").rlike("^L[0-9]+$"), F.substring("sub_id", 2, 18).cast("bigint"))
    start = library.agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("start"))  # one row
    rank = F.row_number().over(Window.orderBy("order")) - 1  # of new entries of a library
    fresh = c.join(holder, "fingerprint", "left_anti").withColumn("rank", rank).crossJoin(F.broadcast(start))
    name = (F.col("start") + F.col("rank")).cast("string")
    new = fresh.select(F.concat(F.lit("L"), F.when(F.length(name) < 2, F.lpad(name, 2, "0")).otherwise(name)).alias("sub_id"), "fingerprint", F.col("more").alias("support"), F.lit(True).alias("is_new"))
    return old.unionByName(new)


def chained(subs: list[str], library: dict[str, Program], varying: dict[tuple[str, str], bool], constants: dict[tuple[str, str], float]) -> Program | None:
    """One program of several: slots that vary over the uses are parameters, those with one value are constants, and the last program's output is the output.

    A slot without uses is a parameter of its own name. Targets get the number of their call before their name, so two
    calls never write the same. Without any parameter left, or with an unknown program: None.
    """
    slots: dict[str, Slot] = {}
    steps: list[Step] = []
    for i, sub in enumerate(subs):
        program = library.get(sub)
        if program is None:
            return None
        names: dict[str, str] = {}
        for s in program.slots:
            key = (sub, s.name)
            if key in constants and not varying.get(key, False):
                names[s.name] = f"k{i}_{s.name}"
                steps.append(Step("assign", names[s.name], repr(float(constants[key])), (), "float"))
                continue
            names[s.name] = f"{sub}_{s.name}" if key in varying else s.name
            slots.setdefault(names[s.name], Slot(names[s.name], s.dtype))
        for step in program.steps:
            text = _renamed(step.expr, names)
            names[step.target] = f"e{i}_{step.target}"
            steps.append(Step(step.op, names[step.target], text, (), step.target_dtype))
    if not slots or len(steps) > MAX_STEPS:
        return None
    return Program("evolved_" + "-".join(subs), tuple(slots.values()), tuple(steps))


def _renamed(expr: str, names: dict[str, str]) -> str:
    import ast

    tree = ast.parse(expr.strip(), mode="eval")
    for n in ast.walk(tree):
        if isinstance(n, ast.Name):
            n.id = names.get(n.id, n.id)
    return ast.unparse(tree)


def verified(candidate: Program, examples: list[tuple[dict, float]], least: float = 0.8, most: int = 10) -> tuple[bool, float]:
    """(passes, share of right results) of a candidate on the first ``most`` examples (bindings, result); none: it fails."""
    used = [(b, g) for b, g in examples[:most] if b]
    good = 0
    for bindings, gold in used:
        ok, out, _, _ = run(candidate, bindings)
        good += bool(ok and isinstance(out, (int, float)) and math.isfinite(out) and abs(out - gold) < 1e-3 * max(abs(gold), 1.0))
    share = good / len(used) if used else 0.0
    return share >= least, share


def evolved(patterns: list[tuple[str, int, float]], library: dict[str, Program], varying: dict, constants: dict, examples, max_size: int = 4096) -> list[dict]:
    """One step of growth: for each pattern ('A>B', support, gain), in their order, the program that it becomes, whether it passes and the id it gets.

    examples: gives the examples of a candidate. Patterns that become no program, fail or repeat one that is there get
    no id. Nothing is added beyond ``max_size`` entries.
    """
    numbers = [int(k[1:]) for k in library if k[:1] == "L" and k[1:].isdigit()]
    nxt, have = max(numbers, default=-1) + 1, {tuple((s.op, s.expr) for s in p.steps) for p in library.values()}
    out, size = [], len(library)
    for gram, support, gain in patterns:
        program = chained(gram.split(">"), library, varying, constants)
        ok, share = verified(program, examples(program)) if program else (False, 0.0)
        body = tuple((s.op, s.expr) for s in program.steps) if program else ()
        sub_id = None
        if ok and body not in have and size < max_size:
            sub_id, nxt, size = f"L{nxt:02d}", nxt + 1, size + 1
            have.add(body)
        out.append({"gram": gram, "n_slots": len(program.slots) if program else 0, "n_steps": len(program.steps) if program else 0, "share": share, "support": support, "mdl_gain": gain, "sub_id": sub_id})
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that each take long, in as many parts as a shuffle has, whatever their size; by a hash of the key that no earlier step can have parted them by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.lit("spread"), key))


# --- bindings for a wanted result ----------------------------------------------------------------------------------


def _values(program: Program, columns: list[np.ndarray]) -> np.ndarray:
    """A program's output for many bindings at once, NaN where it fails; a program that can't be run on arrays is run row by row."""
    try:
        with np.errstate(all="ignore"):
            env = {s.name: np.trunc(c) if s.dtype.strip().lower() == "int" else c for s, c in zip(program.slots, columns)}
            out = None
            for step in program.steps:
                value = evaluate(step.expr, env)
                if not isinstance(value, np.ndarray) or value.dtype != np.float64 or step.target_dtype.strip().lower() != "float":
                    raise TypeError("not a column")
                env[step.target] = np.where(np.isfinite(value), value, np.nan)
                if step.op == "output":
                    out = env[step.target]
        return out if out is not None else np.full(len(columns[0]), np.nan)
    except Exception:  # noqa: BLE001 - functions of single numbers, truth values, texts
        rows = zip(*(c.tolist() for c in columns))
        done = (run(program, dict(zip((s.name for s in program.slots), r))) for r in rows)
        return np.array([float(o) if ok and isinstance(o, (int, float)) else np.nan for ok, o, _, _ in done])


def _hits(values: np.ndarray, gold: float) -> np.ndarray:
    gap = np.abs(values - gold)
    return np.flatnonzero(gap < 1e-3 if gold == 0 else gap < 1e-2 * abs(gold))


def _orders(n: int, k: int, most: int) -> np.ndarray | None:
    """All ways to choose k of n places in order, first places first; None if there are none or more than ``most``."""
    if k > n or math.perm(n, k) > most or k == 0:
        return None
    return np.array(list(itertools.permutations(range(n), k)))


def one_call(values: list[float], gold: float, library: dict[str, Program]) -> tuple[str, list[int], float] | None:
    """(program, places of the values in its slots, result): the first entry and order of the values that give the wanted result to a hundredth."""
    x = np.asarray(values, np.float64)
    for sub, program in library.items():
        order = _orders(len(values), len(program.slots), ONE_CALL)
        if order is None:
            continue
        out = _values(program, list(x[order].T))
        hit = _hits(out, gold)
        if len(hit):
            return sub, order[hit[0]].tolist(), float(out[hit[0]])
    return None


def two_calls(values: list[float], gold: float, library: dict[str, Program]) -> tuple[str, str, float] | None:
    """(first program, second program, result): the first two entries of which the second, with the first one's output in a slot, gives the wanted result.

    Values that the first call uses aren't used again. Both calls' orders are tried at once, as arrays.
    """
    x, n = np.asarray(values, np.float64), len(values)
    for a, first in library.items():
        k = len(first.slots)
        order = _orders(n, k, FIRST_CALL)
        if order is None:
            continue
        r1 = _values(first, list(x[order].T))
        order, r1 = order[np.isfinite(r1)], r1[np.isfinite(r1)]
        if not len(order):
            continue
        rest = np.array([[i for i in range(n) if i not in set(o)] for o in order.tolist()]).reshape(len(order), n - k)
        for b, second in library.items():
            m = len(second.slots)
            inner = np.zeros((1, 0), int) if m == 1 else _orders(n - k, m - 1, SECOND_CALL)
            if m == 0 or inner is None or k + m - 1 > n + 1:
                continue
            others = x[rest[:, inner]].reshape(len(order) * len(inner), m - 1) if m > 1 else np.zeros((len(order), 0))
            given = np.repeat(r1, len(inner))
            for at in range(m):
                columns = [given if i == at else others[:, i - (i > at)] for i in range(m)]
                out = _values(second, columns)
                hit = _hits(out, gold)
                if len(hit):
                    return a, b, float(out[hit[0]])
    return None


def searched_plans(items: DataFrame, library: dict[str, Program], calls: int = 1) -> DataFrame:
    """(item_id, plan, result) of items (item_id, numbers ARRAY<DOUBLE>, gold DOUBLE) for which a plan of one or two calls gives the gold answer.

    Each item is searched on its own in Arrow batches, beside the data. Null numbers or golds are in no row.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for key, numbers, gold in zip(b["item_id"], b["numbers"], b["gold"]):
                found = one_call(list(numbers), gold, library) if calls == 1 else two_calls(list(numbers), gold, library)
                if found:
                    rows.append((key, found[0] if calls == 1 else f"{found[0]}>{found[1]}", found[2]))
            yield pd.DataFrame(rows, columns=["item_id", "plan", "result"])

    rows = items.where("numbers is not null and gold is not null").select("item_id", "numbers", "gold")
    return spread(rows, "item_id").mapInPandas(batches, "item_id bigint, plan string, result double")


def candidate_scores(library: dict[str, Program]) -> list[tuple[str, float, bool]]:
    """(sub_id, score, accepted): 0.3 if a program runs on ones, 0.3 if its result is finite, 0.2 if it is the same again, 0.2 if it changes with the first slot; 0.5 is accepted."""
    out = []
    for sub, program in library.items():
        ones = {s.name: 1.0 for s in program.slots}
        ok, a, _, _ = run(program, ones)
        score = 0.0
        if ok:
            score = 0.3 + 0.3 * (isinstance(a, (int, float)) and math.isfinite(a)) + 0.2 * (run(program, ones)[1] == a)
            if len(ones) > 1:
                ok2, b, _, _ = run(program, ones | {program.slots[0].name: 2.0})
                score += 0.2 * bool(ok2 and b != a)
        out.append((sub, round(score, 6), score >= 0.5))
    return out


# --- repair --------------------------------------------------------------------------------------------------------


class Repairs:
    """A library made ready for ``repaired``: its programs by number, the names of slots and targets as bits of a number."""

    #: Most sets of names whose programs are kept.
    KEPT = 20_000

    def __init__(self, library: dict[str, Program]):
        self.library, self.subs = library, list(library)
        self.programs = [library.get(sub.strip().upper()) for sub in self.subs]
        bits: dict[str, int] = {}
        mask = lambda names: functools.reduce(lambda m, n: m | bits.setdefault(n, 1 << len(bits)), names, 0)
        kind = lambda dtype: (dtype or "float").strip().lower()
        all_ = [p for p in self.programs if p]
        self.bits, self.slots, self.adds, self.ints = bits, {}, {}, {}
        for p in all_:
            self.slots[id(p)] = mask(s.name for s in p.slots)
            self.ints[id(p)] = mask(s.name for s in p.slots if kind(s.dtype) == "int")
            self.adds[id(p)] = self.slots[id(p)] | mask(s.target for s in p.steps)
        self.targets = mask(s.target for p in all_ for s in p.steps)
        self.slot_types = list(dict.fromkeys(s.dtype for p in all_ for s in p.slots))
        self.known_types = all(kind(t) in DTYPES for t in self.slot_types)
        # only with numbers throughout do the names of variables tell which calls can't be bound
        self.numbers = all(kind(t) in ("int", "float", "bool") for p in all_ for t in (*(s.dtype for s in p.slots), *(s.target_dtype for s in p.steps))) and not any(n.startswith("__") for n in bits)
        self._bindable: dict = {}

    def mask(self, given: dict) -> int:
        """The names that have a value."""
        m = 0
        for k, v in given.items():
            if v is not None:
                m |= self.bits.get(k, 0)
        return m

    def bindable(self, have: int, single: frozenset) -> list[int]:
        """The numbers of the programs each slot of which has a value: by its name, or by its type where one variable is of it."""
        key = (have, single)
        if key not in self._bindable:
            if len(self._bindable) >= self.KEPT:
                self._bindable.clear()
            rest = lambda p: (s.dtype for s in p.slots if not self.bits[s.name] & have)
            self._bindable[key] = [x for x, p in enumerate(self.programs) if p and (not self.slots[id(p)] & ~have or (single and all(t in single for t in rest(p))))]
        return self._bindable[key]


def _safe(program: Program, given: dict) -> bool:
    """Whether the values that are bound can be of the slots' types."""
    for s in program.slots:
        if given.get(s.name) is not None:
            try:
                coerce(given[s.name], s.dtype)
            except ValueError:
                return False
    return True


def _reward(made: int, n: int, is_safe: bool, big: bool) -> float:
    """What a plan of n calls is worth of which ``made`` succeed. big: it runs, and its result isn't zero."""
    return 0.25 * made + 0.10 * (n > 0 and made == n) - 0.05 * n - 0.10 * (not is_safe) + 0.20 * big


def repaired(calls: list[tuple[str, dict]], library: dict[str, Program] | Repairs, rounds: int = 3, width: int = 4, max_calls: int = 6) -> tuple[list[tuple[str, dict]], bool, float, int]:
    """(calls, runs, reward, rounds used): a plan whose calls inherit variables, changed until it runs.

    Each round makes every change of every plan in the beam: another entry for a call, another variable for a slot, a
    further call, one call less; and keeps the ``width`` best by their reward, of equal ones the first made. It ends when
    the best plan runs. A change is unsafe if a value that is bound already can't be of the new slot's type.

    No change is left out, but most needn't be run: a change after the call that fails changes nothing before it; the
    calls before a change are run once for all changes of a place; an entry that can't be bound fails there. A change
    whose names alone show that it can't be among the best isn't run either.
    """
    lib = library if isinstance(library, Repairs) else Repairs(library)
    known: dict = {}  # many changes have the same calls

    def called(program: Program | None, given: dict, env: dict) -> tuple[dict, object] | None:
        """The variables after a call, and its output; None if it fails."""
        if program is None:
            return None
        values = {}
        for s in program.slots:
            v = given.get(s.name)
            if v is None:
                v = env.get(s.name)
            if v is None:
                fits = list(itertools.islice(fitting(env, s.dtype), 2))
                if len(fits) != 1:
                    return None
                v = fits[0]
            values[s.name] = v
        if lib.numbers:
            key = (id(program), *values.values())
            if key not in known:
                known[key] = run(program, values)
            ok, out, _, inner = known[key]
        else:  # lists can't be told apart by a hash, and 1 and 1.0 are different texts
            ok, out, _, inner = run(program, values)
        return ({**env, **inner, "__last_output__": out}, out) if ok else None

    def judged(made: int, n: int, out) -> tuple[bool, bool]:
        """(runs, its result isn't zero) of a plan of n calls."""
        good = n > 0 and made == n and isinstance(out, (int, float)) and math.isfinite(out)
        return bool(good), bool(good and abs(out) > 1e-6)

    def best_changes(beam: list[list], width: int) -> list[tuple]:
        """(-reward, plan of the beam, kind, place, number, runs, slot, value) of the best changes, in order; kinds: 0 entry, 1 variable, 2 further call, 3 call less."""
        top: list[tuple] = []

        def out_of_reach(at: tuple) -> bool:
            return len(top) == width and at > top[-1]

        def offer(at: tuple, *more) -> None:
            if not out_of_reach(at):
                bisect.insort(top, (*at, *more))
                del top[width:]

        for b, plan in enumerate(beam):
            n = len(plan)
            programs = [lib.library.get(sub.strip().upper()) for sub, _ in plan]
            masks = [lib.mask(given) for _, given in plan]
            values = [v for _, given in plan for v in given.values() if v is not None]
            finite = all(isinstance(v, (int, float)) and math.isfinite(v) for v in values)
            always_safe, by_names = finite and lib.known_types, finite and lib.numbers
            states: list[tuple[dict, object]] = [({}, None)]  # the variables before each call, up to the one that fails
            while len(states) <= n and (done := called(programs[len(states) - 1], plan[len(states) - 1][1], states[-1][0])):
                states.append(done)
            fails = len(states) - 1  # n: none does

            def blocked(program: Program, bound: int, mask: int) -> bool | None:
                """Whether the names alone show that a call can't be bound; None: they don't tell."""
                missing = lib.slots[id(program)] & ~bound & ~mask
                if not missing:
                    return False
                if mask == 0 or (missing & ~lib.ints[id(program)] and mask.bit_count() > 1) or (mask & ~lib.targets).bit_count() > 1:
                    return True
                return None

            reached: dict[tuple[int, int], int] = {}

            def reach(j: int, mask: int) -> int:
                """At most so many of the plan's calls from its start succeed, if those before j do and leave these names."""
                if (j, mask) not in reached:
                    k, m = j, mask
                    while k < n and programs[k] is not None:
                        stop = blocked(programs[k], masks[k], m)
                        if stop is not False:
                            k = n if stop is None else k
                            break
                        m |= lib.adds[id(programs[k])]
                        k += 1
                    reached[j, mask] = k
                return reached[j, mask]

            # of the variables before each call: their names, whether these tell what can be bound (none but a target can be infinite)
            named = [lib.mask(env) for env, _ in states]
            tells = [by_names and all(math.isfinite(v) for k, v in env.items() if k != "__last_output__" and not lib.bits[k] & lib.targets) for env, _ in states]
            singles: dict[int, frozenset] = {}

            def single(i: int) -> frozenset:
                """The types that just one variable before call i can be of."""
                if i not in singles:
                    singles[i] = frozenset(t for t in lib.slot_types if len(list(itertools.islice(fitting(states[i][0], t), 2))) == 1)
                return singles[i]

            def finished(j: int, done: tuple[dict, object], made: int) -> tuple[int, object]:
                """(calls that succeed, last output) of the plan from call j on."""
                env, out = done
                for k in range(j, n):
                    if (done := called(programs[k], plan[k][1], env)) is None:
                        return made, None
                    (env, out), made = done, made + 1
                return made, out

            def tell(made: int, length: int, out, is_safe: bool, at: tuple, *more) -> None:
                good, big = judged(made, length, out)
                offer((-_reward(made, length, is_safe, big), b, *at), good, *more)

            def may(made: int, length: int, is_safe: bool, at: tuple) -> bool:
                if len(top) < width:
                    return True
                score, last = -_reward(made, length, is_safe, made == length), top[-1]
                return score < last[0] or (score == last[0] and (b, *at) < last[1:])

            def entries(kind: int, i: int, own: str | None, given: dict) -> None:
                """Every entry for call i, or as a further call before it."""
                length, nxt = (n, i + 1) if kind == 0 else (n + 1, i)
                safe = lambda x: True if always_safe or kind == 2 else _safe(lib.library[lib.subs[x]], given)
                runs: list[int] = []
                if i <= fails:
                    env, mask, told = states[i][0], named[i], tells[i]
                    have = mask | lib.mask(given)
                    several = told and (mask & ~lib.targets).bit_count() > 1  # no slot is bound by its type alone, so more names are never worse
                    if several and not may(reach(nxt, have | lib.targets) + (kind == 2), length, True, (kind, i, 0)):
                        return
                    runs = lib.bindable(have, frozenset() if several else single(i))
                    for x in runs:
                        if lib.subs[x] == own:
                            continue
                        is_safe, adds, program = safe(x), lib.adds[id(lib.programs[x])], lib.programs[x]
                        most = reach(nxt, mask | adds) + (kind == 2) if told and not lib.slots[id(program)] & ~have else length
                        if not may(most, length, is_safe, (kind, i, x)):
                            continue
                        done = called(program, given, env)
                        made, out = (i, None) if done is None else finished(nxt, done, i + 1)
                        tell(made, length, out, is_safe, (kind, i, x))
                # the others fail there, or where the plan fails before
                made = min(i, fails)
                if not may(made, length, True, (kind, i, 0)):
                    return
                left = set(runs)
                for x, sub in enumerate(lib.subs):
                    if x not in left and sub != own:
                        if not may(made, length, True, (kind, i, x)):
                            break
                        tell(made, length, None, safe(x), (kind, i, x))

            names = {k: v for _, given in reversed(plan) for k, v in given.items() if v is not None}
            for i in (*range(fails, n), *range(min(fails, n))):  # most is to be won where it fails
                entries(0, i, *plan[i])
            for i, (sub, given) in enumerate(plan):
                if i > fails and not may(fails, n, True, (1, i, 0)):
                    break  # nor can later ones
                program, told = programs[i], programs[i] is not None and i <= fails and tells[i]
                for at, s in enumerate(lib.library[sub].slots if sub in lib.library else ()):
                    most = n if i <= fails else fails
                    if told:
                        stop = blocked(program, masks[i] | lib.bits.get(s.name, 0), named[i])
                        most = i if stop else n if stop is None else reach(i + 1, named[i] | lib.adds[id(program)])
                    for x, (name, value) in enumerate(names.items(), at * len(names)):
                        if not may(most, n, True, (1, i, x)):
                            break  # nor can the slot's later ones
                        if name == s.name:
                            continue
                        made, out = fails, None
                        if i <= fails:
                            done = called(program, {**given, s.name: value}, states[i][0])
                            made, out = (i, None) if done is None else finished(i + 1, done, i + 1)
                        tell(made, n, out, True, (1, i, x), s.name, value)
            for i in range(n + 1) if n < max_calls else ():
                if i > fails and not may(fails, n + 1, True, (2, i, 0)):
                    break
                entries(2, i, None, {})
            for i in range(n) if n > 1 else ():
                if may(n - 1 if i <= fails else fails, n - 1, True, (3, i, 0)):
                    made, out = finished(i + 1, states[i], i) if i <= fails else (fails, None)
                    tell(made, n - 1, out, True, (3, i, 0))
        return top

    def changed(plan: list, kind: int, i: int, x: int, slot: str | None = None, value=None) -> list:
        if kind == 0:
            return [*plan[:i], (lib.subs[x], plan[i][1]), *plan[i + 1 :]]
        if kind == 1:
            return [*plan[:i], (plan[i][0], {**plan[i][1], slot: value}), *plan[i + 1 :]]
        return [*plan[:i], (lib.subs[x], {}), *plan[i:]] if kind == 2 else [*plan[:i], *plan[i + 1 :]]

    start = [((sub or "").strip().upper(), dict(given or {})) for sub, given in calls]
    ok, out, made, _ = compose(start, lib.library)
    good, big = judged(made, len(start), out)
    best, beam = (_reward(made, len(start), True, big), start, good), [start]
    for used in range(1, rounds + 1):
        top = best_changes(beam, width if used < rounds else 1)  # after the last round only the best counts
        beam = [changed(beam[b], kind, i, x, *more) for _, b, kind, i, x, _, *more in top]
        if top and -top[0][0] > best[0]:
            best = (-top[0][0], beam[0], top[0][5])
        if best[2]:
            return best[1], True, round(best[0], 6), used
    return best[1], best[2], round(best[0], 6), rounds


def repaired_plans(plans: DataFrame, library: dict[str, Program]) -> DataFrame:
    """(plan_key, ran, plan, runs, reward, rounds) of plans (plan_key, steps ARRAY<STRUCT<sub_id, bindings MAP>>): those that don't run are repaired.

    Null or empty steps have no plan and stay as they are. Each plan is searched on its own in Arrow batches.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = Repairs(library)
        for b in it:
            rows = []
            for key, steps in zip(b["plan_key"], b["steps"]):
                calls = [((s["sub_id"] or "").strip().upper(), dict(s["bindings"]) if s["bindings"] is not None else {}) for s in (steps if steps is not None else []) if s is not None]
                ok, out, _, _ = compose(calls, library)
                ran = bool(ok and isinstance(out, (int, float)) and math.isfinite(out))
                plan, runs, score, used = (calls, ran, None, 0) if ran or not calls else repaired(calls, ready)
                rows.append((key, ran, ">".join(c for c, _ in plan), runs, score, used))
            yield pd.DataFrame(rows, columns=["plan_key", "ran", "plan", "runs", "reward", "rounds"]).astype({"reward": "float64"})

    return spread(plans.select("plan_key", "steps"), "plan_key").mapInPandas(batches, "plan_key bigint, ran boolean, plan string, runs boolean, reward double, rounds bigint")
