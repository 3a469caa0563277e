"""Problems 2, 3, 4 and 7 against brute force, with nulls, repeats, hot groups, clashing columns and empty tables."""

import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.llm import canonical, cooccur, mixing, overlap, skew
from planloom.plans.schemas import SLOT, STEP

ITEMS = "item_id bigint, split string, source string, problem string, answer string, key string, class_id bigint, side boolean"
PROGRAMS = f"row_id bigint, slots array<{SLOT.simpleString()}>, steps array<{STEP.simpleString()}>, output string, key string, id bigint"


def item(i, split, problem, answer, source="s"):
    return (i, split, source, problem, answer, "clash", 1, True)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def found(spark, rows):
    return sorted(map(tuple, overlap.overlap_pairs(spark.createDataFrame(rows, ITEMS)).collect()))


def test_overlaps_small(spark):
    base = "Mara owns 1,200 red marbles in the old shed and gives 45 of them to Tom before noon"
    rows = [
        item(1, "train", base, "1155"), item(2, " TEST ", base.upper().replace("1,200", "1200"), "#### 1,155.00"), item(3, "dev", base.replace("red", "blue").replace("old", "new"), "1155 marbles"),
        item(4, "test", base.replace("45", "46"), "1155"), item(5, "test", base, "1154"), item(6, None, base, "1155"), item(7, "train", None, "1155"), item(8, "dev", base, None),
        item(9, "train", " ".join(f"w{i}" for i in range(14)), "1155"), item(2, "test", base.upper().replace("1,200", "1200"), "#### 1,155.00"), item(None, "dev", base, "1155"), item(10, "other", base, "1155"),
        item(11, "test", "", "3"), item(12, "train", "", "3.0"),
    ]
    assert found(spark, rows) == [(1, 2), (1, 3), (11, 12)]
    counts = {(r.split, r.source): (r.n_pairs, r.n_items) for r in overlap.overlap_counts(spark.createDataFrame(rows, ITEMS)).collect()}
    assert counts == {("test", "s"): (2, 2), ("dev", "s"): (1, 1)}
    assert found(spark, []) == []


def test_overlaps_against_brute_force_in_one_hot_group(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(25)]
    texts = []
    for k in range(160):
        ws = list(rng.choice(bases))
        for _ in range(rng.randint(0, 9)):
            op, at = rng.random(), rng.randrange(len(ws))
            if op < 0.5:
                ws[at] = rng.choice(vocabulary)
            elif op < 0.75:
                ws.insert(at, rng.choice(vocabulary))
            elif len(ws) > 5:
                del ws[at]
        texts.append(ws)
    rows = [item(k, ("train", "train", "dev", "test")[k % 4], " ".join(ws), "7") for k, ws in enumerate(texts)]  # all in one group
    digits = [re.findall(r"\d+", r[3]) for r in rows]
    want = sorted(
        (i, j) for i, j in itertools.combinations(range(160), 2)
        if (i % 4 < 2) != (j % 4 < 2) and digits[i] == digits[j] and distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])) + 1e-9
    )
    got = found(spark, rows)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)


def test_near_words_with_equal_numbers(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    base = [rng.choice(names) for _ in range(40)]
    rows = [item(0, "train", " ".join(base), "7")]
    for k in range(1, 60):
        ws = list(base)
        for at in rng.sample(range(40), k % 12):
            ws[at] = rng.choice(names)
        rows.append(item(k, "test", " ".join(ws), "7"))
    want = [(0, k) for k in range(1, 60) if distance(base, rows[k][3].split()) <= 8]
    assert found(spark, rows) == want


def test_a_large_group_is_split_by_its_blocks(spark):
    rng = random.Random(9)
    vocabulary = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxy'[i // 100]}" for i in range(500)]
    common = ["the", "of", "and", "a", "in", "to", "is", "all"]
    rows, want = [], []
    for k in range(4000):
        ws = [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(40)]
        rows.append(item(k, "train", " ".join(ws), "7"))
        if k % 2:
            rows.append(item(10_000 + k, "dev", " ".join(rng.choice(vocabulary) for _ in range(40)), "7"))
        if k % 20 == 0:
            for at in rng.sample(range(40), 8 if k % 40 else 3):
                ws[at] = rng.choice(vocabulary)
            rows.append(item(20_000 + k, "test", " ".join(ws), "7"))
            want.append((k, 20_000 + k))
    rows += [item(30_000 + k, "test", rows[0][3], "7") for k in range(40)] + [item(40_000 + k, "train", rows[0][3].upper(), "7") for k in range(40)]
    want += [(a, b) for a in (0, *range(40_000, 40_040)) for b in (20_000, *range(30_000, 30_040)) if (a, b) != (0, 20_000)]
    got = found(spark, rows)
    want = sorted((min(p), max(p)) for p in want)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    df = spark.createDataFrame(rows, ITEMS)
    links, members = overlap.linked_classes(df)
    assert links.count() <= 202  # 41 x 40 rows of one text are one link
    counts = {(r.split, r.source): r.n_pairs for r in overlap.overlap_counts(df).collect()}
    assert counts == {("test", "s"): len(got)}
    per_item = {r.item_id: (r.class_id, r.n_links) for r in overlap.overlap_classes(df).collect()}
    assert set(per_item) == {i for p in got for i in p} and per_item[40_039] == per_item[0]


def test_repeated_words_weigh_so_that_a_fifth_keeps_its_angle():
    rng = random.Random(10)
    worst = 0
    for n in (5, 10, 40, 200):
        for _ in range(40):
            ws = [rng.choice(["Mara", "Tom", "x", *(f"w{i}" for i in range(n))]) for _ in range(n)]
            new = list(ws)
            for at in rng.sample(range(n), n // 5):
                new[at] = "Zoe"
            worst = max(worst, int((overlap.simhash(ws) != overlap.simhash(new)).sum()))
    assert worst <= overlap.RADIUS
    assert all((1 - (1 - overlap.MAX_DIFFERS) ** k) ** overlap.block_count(k) <= overlap.MISS for k in range(overlap.SHORTEST, overlap.LONGEST + 1))


def test_distance_by_bit_vectors():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        k = rng.randint(0, 6)
        assert overlap.within(a, b, k) == (distance(a, b) <= k)


def program_row(i, slots, steps, text=False):
    if text:
        body = {"steps": [dict(zip(("op", "target", "expr", "inputs", "target_dtype"), s)) for s in steps], "program_id": "p", "slots": [dict(zip(("name", "dtype", "description"), s)) for s in slots]}
        return (i, None, None, json.dumps(body), "clash", 0)
    return (i, slots, steps, None, "clash", 0)


def test_copies_in_many_ways_of_writing(spark):
    slots, steps = [("unit_price", "float", "d"), ("n", "int", None)], [("compute", "t_1", "unit_price * n", ["unit_price", "n"], "float"), ("output", "t_1", "t_1", ["t_1"], "float")]
    other = [("output", "t_1", "t_1", ["t_1"], "float"), steps[0]]
    rows = [
        program_row(5, slots, steps), program_row(3, slots[::-1], [("COMPUTE", "T 1", " Unit_Price*n ;", ["N", "unit-price"], "Float"), steps[1]]), program_row(9, slots, steps, True),
        program_row(4, slots, other), program_row(6, slots, [("compute", "t_1", "unit_price + n", ["unit_price", "n"], "float"), steps[1]]), (7, None, None, None, None, 0), (8, None, None, "{broken", None, 0),
        program_row(5, slots, steps), program_row(None, slots, steps), (10, [None], [None], None, None, 0), (11, [], None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, PROGRAMS)
    assert sorted(map(tuple, canonical.program_copies(df).collect())) == [(3, 5), (3, 9)]
    records = {r.row_id: r.n_copies for r in canonical.program_records(df).collect()}
    assert records == {3: 3, 4: 1, 6: 1, 10: 1, 11: 1}
    assert canonical.program_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("rows_of_a_task", [1, 20, 100_000])
def test_hot_and_cold_keys_give_the_same(spark, rows_of_a_task):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(200)}") for i in rng.sample(range(10_000), 3000)] + [(1, "k1"), (1, "k1")]
    groups = defaultdict(set)
    for i, k in rows:
        groups[k].add(i)
    df = spark.createDataFrame(rows, "id bigint, key string")
    got = {(r.key, r.id): (r.keep_id, r.n_copies) for r in canonical.collapse(df, rows_of_a_task).collect()}
    assert got == {(k, i): (min(v), len(v)) for k, v in groups.items() for i in v}
    if rows_of_a_task == 20:
        hot = {r.key: r.salts for r in skew.hot_keys(df, ["key"], 20).collect()}
        assert hot["hot"] == -(-len(groups["hot"]) // 20) and set(hot) == {k for k, v in groups.items() if sum(x == k for _, x in rows) > 20}


def test_a_third_of_all_rows_under_one_key(spark):
    df = spark.range(600_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    c = canonical.collapse(df)
    assert c.where("key = 'hot' and keep_id = 0 and n_copies = 200000").count() == 200_000 and c.where("id = keep_id").count() == 400_001


@pytest.mark.parametrize("heavy", [2.0, 0.05, 0.0])
def test_pairs_against_brute_force(spark, heavy):
    rng = random.Random(3)
    sets = [sorted({f"i{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randint(0, 8))}) for _ in range(500)] + [[], ["i0"]]
    df = spark.createDataFrame(list(enumerate(sets)), "basket bigint, items array<string>")
    single, pair = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(s, 2))
    for least in (1, 5):
        rows = cooccur.cooccurrence(df, least, heavy_share=heavy, part=3).collect()
        got = {(r.item_a, r.item_b): (r.n_both, r.n_a, r.n_b, r.n_baskets) for r in rows}
        assert len(rows) == len(got) and all(r.lift == pytest.approx(r.n_both * r.n_baskets / (r.n_a * r.n_b)) for r in rows)
        assert got == {(a, b): (c, single[a], single[b], len(sets)) for (a, b), c in pair.items() if c >= least}
    assert cooccur.cooccurrence(df.where("false")).count() == 0


def test_fewer_heavy_items_than_are_frequent(spark):
    sets = [[f"i{x}" for x in range(k % 7)] for k in range(300)]
    df = spark.createDataFrame(list(enumerate(sets)), "basket bigint, items array<string>")
    every = {tuple(r) for r in cooccur.cooccurrence(df).collect()}
    assert every == {tuple(r) for r in cooccur.cooccurrence(df, max_heavy=2).collect()} and len(every) == 15


def test_a_basket_with_very_many_items(spark):
    n = 3000
    df = spark.createDataFrame([(0, [f"i{k}" for k in range(n)]), (1, ["i1", "i2"])], "basket bigint, items array<string>")
    c = cooccur.cooccurrence(df, heavy_share=2.0)
    assert c.agg(F.count("*"), F.sum("n_both")).first()[:] == (n * (n - 1) // 2, n * (n - 1) // 2 + 1)


def test_codes_are_unlike(spark, monkeypatch):
    singles = spark.range(5000).select(F.concat(F.lit("i"), "id").alias("item"), F.lit(1).alias("n_item"))
    monkeypatch.setattr(F, "xxhash64", lambda c: F.pmod(F.hash(c), F.lit(30)).cast("bigint") * 2**14)
    c = cooccur.coded(singles, ["i7", "i9"])
    assert c.select(F.countDistinct("code"), F.count("*")).first()[:] == (5000, 5000) and sorted(r.code for r in c.where("item in ('i7', 'i9')").collect()) == [0, 1]


def test_baskets_of_dirty_rows(spark):
    df = spark.createDataFrame([(1, ["a ", "A", None, "B"], "x"), (1, ["a ", "A", None, "B"], "x"), (2, None, "x"), (3, [], "x"), (None, ["A"], "x"), (4, ["Q"], "x")], "k bigint, ids array<string>, items string")
    names = spark.createDataFrame([("A",), ("b",), (None,), ("A",)], "sub_id string")
    got = {r.basket: sorted(r["items"]) for r in cooccur.respelled(cooccur.baskets(df, "k", "ids"), "items", names, "sub_id").collect()}
    assert got == {1: ["A", "b"], 2: [], 3: [], 4: []}


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 1000, 4097):
        for seed in (0, 9):
            assert sorted(mixing.permuted(np.arange(n), n, seed).tolist()) == list(range(n))


def test_shares_of_capped_sources():
    p = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000.0, "b": 50.0, "c": 1000.0}, 1000.0)
    assert p["b"] == pytest.approx(0.05) and p["a"] == pytest.approx(0.95 * 5 / 7) and sum(p.values()) == pytest.approx(1)


def test_mixture(spark):
    docs = [(i, f"{' '.join(['apple tree'] * (3 + i % 40))}.", "big " if i % 2 else "BIG", "x") for i in range(2000)] + [(5000 + i, "small text here and there. " * 5, "tiny-one", "x") for i in range(20)]
    docs += [(9000, None, "big", "x"), (9001, "", "big", "x"), (9002, "no target", "other", "x"), (None, "text", "big", "x"), (9003, "word " * 30_000, "big", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens string")
    t = spark.createDataFrame([("big", 0.6, 1), ("tiny_one", 0.3, 4), ("absent", 0.1, 9), (None, 0.1, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mixture(d, t, total_tokens=40_000)
    rows = uses.collect()
    assert {r.source for r in rows} <= {"big", "tiny_one"} and all(r.uses <= {"big": 1, "tiny_one": 4}[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "tiny_one", "absent", "zero"} and rep["big"].reached and not rep["tiny_one"].reached and not rep["absent"].reached
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1) and rep["tiny_one"].used_tokens == 4 * rep["tiny_one"].available_tokens
    assert uses.columns == ["doc_id", "source", "tokens", "uses", "used_tokens"] and all(0 < r.used_tokens <= r.uses * r.tokens for r in rows)
    assert sum(r.used_tokens for r in rows) == sum(r.used_tokens for r in rep.values())
    assert rep["big"].drawn_share > rep["big"].target_share > rep["tiny_one"].drawn_share
    again = {(r.doc_id, r.uses) for r in mixing.mixture(d, t, total_tokens=40_000)[0].collect()}
    assert again == {(r.doc_id, r.uses) for r in rows}
    for dd, tt in ((d.where("false"), t), (d, t.where("false"))):
        u, r = mixing.mixture(dd, tt)
        assert u.count() == 0 and all(x.actual_share == 0 for x in r.collect())


def test_shares_are_met(spark):
    docs = [(i, "one two three four five six seven eight nine ten " * (1 + i % 9), ("a", "b")[i % 3 == 0]) for i in range(6000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    rep = mixing.mixture(d, t)[1].collect()
    assert all(r.reached and abs(r.actual_share - 0.5) < 0.03 for r in rep)
    assert d.select(F.countDistinct("doc_id")).first()[0] == 6000


def test_blocks_have_one_size_and_hold_every_token(spark):
    rng = random.Random(12)
    docs = [(i, "ab"[i % 2], rng.choice([1, 2, 50, 300])) for i in range(400)]
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    parts = mixing.packed(mixing.placed(counted, 400), 64).collect()
    blocks, tokens = Counter(), Counter()
    for r in parts:
        blocks[r.source, r.block] += r.part
        tokens[r.doc_id] += r.part
    assert tokens == {i: t for i, _, t in docs}
    for s in "ab":
        n = sum(t for _, x, t in docs if x == s)
        assert [blocks[s, k] for k in range(-(-n // 64))] == [64] * (n // 64) + ([n % 64] if n % 64 else [])


def test_slots_are_mapped_in_many_tasks(spark):
    n, size = 2_000_000, 300_000
    taken = mixing.taken_blocks(spark, {"a": 0.25, "b": 0.75}, {"a": size, "b": size}, {"a": 3, "b": 4}, n)
    got = {(r.source, r.uses): r.n for r in taken.groupBy("source", "uses").agg(F.count("*").alias("n")).collect()}
    a = sum(u * k for (s, u), k in got.items() if s == "a")
    assert a + sum(u * k for (s, u), k in got.items() if s == "b") <= n and abs(a / n - 0.25) < 0.005
    assert got["b", 4] == size and {u for s, u in got if s == "a"} <= {1, 2} and sum(k for (s, u), k in got.items() if s == "a") == size
    slots = mixing._first_slots(spark.createDataFrame([("a", k, k % 7) for k in range(9000)], "source string, shard bigint, n bigint")).orderBy("shard").collect()
    assert len(slots) == 9000 and slots[0].first == 0 and all(y.first == x.first + x.n for x, y in zip(slots, slots[1:]))
