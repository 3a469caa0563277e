"""Search over plans: bindings by bounded permutations, edits of a plan with their rewards, rollout rewards, tree search."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.plans.programs import Program, run

#: Most orders of numbers that are tried for one program (fixed value).
MAX_ORDERS = 2000
#: Results nearer than this to 0 or 1 count as such (fixed value). So do the weights of the rewards below.
NEAR = 1e-6
#: Most entries of a library that the neighbours of a plan are made of.
MAX_LIBRARY = 4096


def permutations(df: DataFrame, key: str, values: str, k: str) -> DataFrame:
    """(key, order ARRAY<INT>, rank): ways to choose ``k`` of the values in order, where there are at most ``MAX_ORDERS``.

    Rows with more ways get the first values in order as the only one; the number is known before anything is exploded.
    """
    n, kk = F.size(values), F.col(k)
    ways = F.aggregate(F.when(kk > 0, F.sequence(F.lit(0), kk - 1)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda p, i: p * (n - i))
    base = df.where((kk > 0) & (n >= kk)).select(key, F.expr(f"sequence(0, size({values}) - 1)").alias("all"), kk.cast("int").alias("k"), ways.alias("ways"))
    small = base.where(F.col("ways") <= MAX_ORDERS)
    # one position at a time: orders of length i + 1 from those of length i
    step = "flatten(transform(acc, o -> transform(filter(all, x -> NOT array_contains(o, x)), x -> concat(o, array(x)))))"
    grown = small.withColumn("orders", F.expr(f"aggregate(sequence(1, k), array(CAST(array() AS array<int>)), (acc, i) -> {step})"))
    one = base.where(F.col("ways") > MAX_ORDERS).select(key, F.lit(0).alias("rank"), F.expr("slice(all, 1, k)").alias("order"))
    return grown.select(key, F.posexplode("orders").alias("rank", "order")).unionByName(one)


def edits(plans: DataFrame, library: DataFrame, max_calls: int = 6) -> DataFrame:
    """(plan_key, edit, at, sub, subs ARRAY<STRING>): plans that differ by one change in their calls.

    substitute a call by another program, insert one where there is room, delete one where another is left. plans:
    (plan_key, subs); library: (sub_id), whose size is checked: every entry at every place is the operator's result.
    """
    ids = [r.sub_id for r in library.where("sub_id is not null").select("sub_id").distinct().orderBy("sub_id").limit(MAX_LIBRARY + 1).collect()]
    if len(ids) > MAX_LIBRARY:
        raise ValueError(f"a library of more than {MAX_LIBRARY} entries has too many neighbours")
    lib = F.explode(F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")).alias("sub")
    p = plans.where(F.size("subs") > 0)
    sub = p.select("plan_key", "subs", F.posexplode("subs").alias("at", "old")).select("*", lib).where("sub <> old")
    substitute = sub.select("plan_key", F.lit("substitute").alias("edit"), "at", "sub", F.expr("transform(subs, (s, i) -> if(i = at, sub, s))").alias("subs"))
    ins = p.where(F.size("subs") < max_calls).select("plan_key", "subs", F.explode(F.sequence(F.lit(0), F.size("subs"))).alias("at")).select("*", lib)
    insert = ins.select("plan_key", F.lit("insert").alias("edit"), "at", "sub", F.expr("concat(slice(subs, 1, at), array(sub), slice(subs, at + 1, size(subs)))").alias("subs"))
    rest = p.where(F.size("subs") > 1).select("plan_key", "subs", F.explode(F.sequence(F.lit(0), F.size("subs") - 1)).alias("at"))
    delete = rest.select("plan_key", F.lit("delete").alias("edit"), "at", F.lit(None).cast("string").alias("sub"), F.expr("concat(slice(subs, 1, at), slice(subs, at + 2, size(subs)))").alias("subs"))
    return substitute.unionByName(insert).unionByName(delete).withColumn("at", F.col("at").cast("bigint"))


def rebinds(plans: DataFrame, library: DataFrame) -> DataFrame:
    """(plan_key, edit, at, slot, name, value): the changes of one slot of a call to another variable of the plan.

    plans: (plan_key, calls); library: (sub_id, program). The variables of a plan are the slots that it binds to a
    quantity or a constant, by name; of several values of a name the first counts. Calls of unknown programs have none.
    """
    entries = library.select(F.upper(F.trim("sub_id")).alias("_sub"), F.transform("program.slots", lambda s: s["name"]).alias("_slots"))
    c = plans.select("plan_key", F.posexplode("calls").alias("at", "c"))
    own = c.select("plan_key", "at", F.posexplode("c.bindings").alias("i", "name", "r")).where("r.source in ('quantity', 'constant') and r.value is not null")
    env = own.groupBy("plan_key", "name").agg(F.min_by("r.value", F.struct("at", "i")).alias("value"))
    slots = c.select("plan_key", "at", F.upper(F.trim("c.sub_id")).alias("_sub")).join(entries, "_sub").select("plan_key", "at", F.explode("_slots").alias("slot"))
    return slots.join(env, "plan_key").where("slot <> name").select("plan_key", F.lit("rebind").alias("edit"), F.col("at").cast("bigint").alias("at"), "slot", "name", "value")


def edit_counts(plans: DataFrame, library: DataFrame, max_calls: int = 6) -> DataFrame:
    """(edit, n): how many ``edits`` and ``rebinds`` there are over the whole library, without a row for each of the edits."""
    entries = library.where("sub_id is not null")
    ids = F.broadcast(entries.select("sub_id").distinct().agg(F.collect_set("sub_id").alias("ids")))  # one row, a library
    k = F.size("calls")
    p = plans.where(k > 0).crossJoin(ids).select(
        k.alias("k"), F.size("ids").alias("m"), F.size(F.filter(F.transform("calls", lambda c: F.upper(F.trim(c["sub_id"]))), lambda s: s.isNull() | F.array_contains("ids", s))).alias("_same"),
        F.size(F.filter("calls", lambda c: F.upper(F.trim(c["sub_id"])).isNull())).alias("_none"),
    )
    # a call without a program has no substitution in ``edits``, any other one by each entry but its own
    substitute = (F.col("k") - F.col("_none")) * F.col("m") - (F.col("_same") - F.col("_none"))
    n = {
        "substitute": substitute,
        "insert": F.when(F.col("k") < max_calls, (F.col("k") + 1) * F.col("m")).otherwise(0),
        "delete": F.when(F.col("k") > 1, F.col("k")).otherwise(0),
    }
    sums = p.agg(*(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(e) for e, c in n.items()))
    counted = sums.select(F.explode(F.array(*(F.struct(F.lit(e).alias("edit"), F.col(e).alias("n")) for e in n))).alias("x")).select("x.*")
    return counted.unionByName(rebinds(plans, entries).agg(F.count("*").alias("n")).select(F.lit("rebind").alias("edit"), "n"))


def repair_reward(made: Column, n_calls: Column, unsafe: Column, result: Column) -> Column:
    """0.25 for each call that ran, 0.10 if all did, less 0.05 a call and 0.10 for each unsafe edit, 0.20 for a finite result other than 0."""
    good = result.isNotNull() & ~F.isnan(result) & (F.abs(result) < float("inf")) & (F.abs(result) > NEAR)
    return 0.25 * made + F.when((n_calls > 0) & (made == n_calls), 0.10).otherwise(0.0) - 0.05 * n_calls - 0.10 * unsafe + F.when(good, 0.20).otherwise(0.0)


def rollout_reward(result: Column, n_calls: Column) -> Column:
    """0.4 for a finite result, up to 0.3 for three calls, 0.2 unless it is 0 or 1, 0.1 for a magnitude between 0.01 and 1e8."""
    finite = result.isNotNull() & ~F.isnan(result) & (F.abs(result) < float("inf"))
    return F.when(finite, 0.4 + 0.3 * F.least(n_calls / 3, F.lit(1.0)) + F.when((F.abs(result) > NEAR) & (F.abs(result - 1) > NEAR), 0.2).otherwise(0.0) + F.when((F.abs(result) > 0.01) & (F.abs(result) < 1e8), 0.1).otherwise(0.0)).otherwise(0.0)


def composition_reward(parsed: Column, ok: Column, has_gold: Column, match: Column) -> Column:
    """0 if it can't be parsed, 0.1 if it fails, 0.5 if it runs and there is nothing to compare with, 1 if it is right, 0 if wrong."""
    return F.when(~parsed, 0.0).when(~ok, 0.1).when(~has_gold, 0.5).when(match, 1.0).otherwise(0.0)


def flat_reward(parsed: Column, ok: Column, match: Column) -> Column:
    """0 if it can't be parsed, 0.1 if it fails, 0.2 if it is wrong, 1 if it is right."""
    return F.when(~parsed, 0.0).when(~ok, 0.1).when(match, 1.0).otherwise(0.2)


def beam(df: DataFrame, key: str, score: str, tie: str, width: int = 4) -> DataFrame:
    """The ``width`` best rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= width).drop("_r")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` corpus rows nearest to each query by cosine, ties by id.

    The queries are a stated set; they go to the tasks in blocks. A task keeps only its own k best of a query, so what is
    shuffled is k rows for each query and task. Null and zero vectors are left out.
    """
    import numpy as np
    import pandas as pd

    rows = sorted(((r[key], np.asarray(r[vector], np.float64)) for r in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator()), key=lambda x: x[0])
    rows = [(i, v / np.linalg.norm(v)) for i, v in rows if np.linalg.norm(v) > 0]
    docs = corpus.where(F.col(vector).isNotNull()).select(key, vector)
    found = None
    for at in range(0, len(rows), block):
        ids, matrix = [i for i, _ in rows[at : at + block]], np.stack([v for _, v in rows[at : at + block]])

        def nearest(it: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            best: dict[int, list[tuple[float, int]]] = {}
            for b in it:
                x = np.stack([np.asarray(v, np.float64) for v in b[vector]]) if len(b) else np.zeros((0, matrix.shape[1]))
                norm = np.linalg.norm(x, axis=1)
                x, own = x[norm > 0] / norm[norm > 0, None], b[key].to_numpy()[norm > 0]
                for q, scores in zip(ids, np.round(matrix @ x.T, 9)):
                    order = np.lexsort((own, -scores))[:k]
                    best[q] = sorted([*best.get(q, []), *((-scores[j], int(own[j])) for j in order)])[:k]
            out = [(q, i, -s) for q, pairs in best.items() for s, i in pairs]
            yield pd.DataFrame(out, columns=["query_id", key, "score"])

        part = docs.mapInPandas(nearest, f"query_id bigint, {key} bigint, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return corpus.sparkSession.createDataFrame([], f"query_id bigint, {key} bigint, score double, rank bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


# --- tree search, one problem to a row ---------------------------------------------------------------------------


def _reward(value: float | None, depth: int) -> float:
    if value is None or not math.isfinite(value):
        return 0.0
    return 0.4 + 0.3 * min(depth / 3, 1) + 0.2 * (abs(value) > NEAR and abs(value - 1) > NEAR) + 0.1 * (0.01 < abs(value) < 1e8)


def tree_search(numbers: list[float], library: dict[str, Program], rounds: int = 50, depth: int = 5, c: float = 1.4, seed: int = 42) -> tuple[list[str], float | None, float]:
    """(programs, value, reward) of the best chain of calls that a seeded upper-confidence tree search finds.

    A state is the list of values so far; a call takes the last values, one for each slot, and adds its output. Each
    round expands one node by every entry that runs there and scores each of them as a chain that stops there; then
    entries drawn at random go on from the node, up to ``depth`` calls, as a rollout. ``seed`` is for these draws and
    for the order of entries that are equally good.
    """
    rng = random.Random(seed)
    names = sorted(library)
    rng.shuffle(names)
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    values: dict[tuple[str, ...], list[float]] = {(): list(numbers)}
    visits: dict[tuple[str, ...], int] = {(): 0}
    total: dict[tuple[str, ...], float] = {(): 0.0}

    def called(have: list[float], program: Program) -> float | None:
        k = len(program.slots)
        if k > len(have):
            return None
        ok, out, _, _ = run(program, dict(zip((s.name for s in program.slots), have[-k:] if k else [])))
        return float(out) if ok and isinstance(out, (int, float)) else None

    best: tuple[float, tuple[str, ...], float | None] = (-1.0, (), None)
    for _ in range(rounds):
        path: tuple[str, ...] = ()
        while children.get(path):
            n = math.log(visits[path] + 1)
            path = max(children[path], key=lambda p: total[p] / visits[p] + c * math.sqrt(n / visits[p]))
        gained = [_reward(values[path][-1], len(path))] if path else []
        if path not in children:
            children[path] = []
            for name in names if len(path) < depth else []:
                value = called(values[path], library[name])
                if value is None:
                    continue
                child = (*path, name)
                reward = _reward(value, len(child))
                children[path].append(child)
                values[child], visits[child], total[child] = [*values[path], value], 1, reward
                gained.append(reward)
                if (reward, -len(child)) > (best[0], -len(best[1])):
                    best = (reward, child, value)
        chain, have = path, values[path]
        for name in rng.choices(names, k=depth - len(path)) if names else []:
            value = called(have, library[name])
            if value is None:
                continue
            chain, have = (*chain, name), [*have, value]
            reward = _reward(value, len(chain))
            gained.append(reward)
            if (reward, -len(chain)) > (best[0], -len(best[1])):
                best = (reward, chain, value)
        gain = max(gained, default=0.0)
        for i in range(len(path) + 1):
            visits[path[:i]] += 1
            total[path[:i]] += gain
    return list(best[1]), best[2], max(best[0], 0.0)


def searched(problems: DataFrame, library: dict[str, Program], rounds: int = 50, seed: int = 42) -> DataFrame:
    """(item_id, plan, value, reward) of problems (item_id, numbers ARRAY<DOUBLE>), each searched on its own."""
    import pandas as pd

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for key, nums in zip(b["item_id"], b["numbers"]):
                path, value, reward = tree_search([float(x) for x in (nums if nums is not None else [])], library, rounds, seed=seed)
                rows.append((key, ">".join(path), value, round(reward, 6)))
            yield pd.DataFrame(rows, columns=["item_id", "plan", "value", "reward"]).astype({"value": "float64"})

    return problems.select("item_id", "numbers").mapInPandas(batches, "item_id bigint, plan string, value double, reward double")
