"""Problems 5, 6 and 8 on small fixtures and against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.llm import pairs, quality, tiling

MESSAGES = "msg_id bigint, conv_id bigint, turn bigint, role string, content string, defect string, text string, q string"
Q = "Mara begins with 12 red marbles stored in the old shed. She gives 5 of them to Tom. How many marbles are left in the end?"
DE = "Mara hat 12 rote Murmeln in dem alten Schuppen und gibt 5 an Tom. Wie viele Murmeln sind noch da?"
FULL = "At first there are 12 of them. Taking away 5 leaves 12 - 5 = 7. That leaves 7 marbles in total."
CASES = {
    (Q, FULL): None,
    (Q, "7"): None,
    (Q, "7 marbles"): None,
    (Q, "#### 7"): None,
    (Q, '{"answer": 7}'): None,
    (Q, f"The question was: {Q} {FULL}"): None,
    (Q, "I am sorry for the clumsy notation, but it works. They cannot keep 5 of these, hence 7 stay. The answer is 7."): None,
    (Q, "Wrong but complete: the answer is 99."): None,
    (Q, None): "empty",
    (Q, " ​\n"): "empty",
    (Q, "<p></p>"): "empty",
    (Q, "N/A"): "empty",
    (Q, '{"slots": [], "steps": []}'): "empty",
    (Q, "```json\n```"): "empty",
    (Q, "..."): "empty",
    (Q, FULL[:60] + " and"): "truncated",
    (Q, "At first there are 12 of them. Taking away 5 leaves 12 - 5 ..."): "truncated",
    (Q, '{"slots": [{"name": "start", "dtype": "int"}], "steps": [{"op": "comp'): "truncated",
    (Q, "Sorry, I am unable to solve the question you sent."): "refusal",
    (Q, '{"error": "I must decline to answer this request."}'): "refusal",
    (Q, "I’m not able to work on such a task."): "refusal",
    (DE, "Leider kann ich bei dieser Aufgabe nicht helfen."): "refusal",
    (Q, Q): "copied",
    (Q, f"You ask: {Q.upper()}"): "copied",
    (Q, "Wir beginnen mit der Zahl 12. Nun sind es 7, weil sich der Bestand ändert. Am Ende bleiben 7 übrig."): "other_language",
    (DE, FULL): "other_language",
    (DE, "Zuerst sind es 12 Murmeln. Das Ergebnis ist also 7."): None,
}


def found(spark, rows):
    rows = [(i, *r, "clash", "clash", "clash") for i, r in enumerate(rows)]
    return sorted((r.conv_id, r.turn, r.defect) for r in pairs.defects(spark.createDataFrame(rows, MESSAGES)).collect())


def test_each_kind_of_defect(spark):
    rows = [m for k, (q, a) in enumerate(CASES) for m in ((k, 0, "user", q), (k, 1, "assistant", a))]
    want = sorted((k, 0, d) for k, d in enumerate(CASES.values()) if d)
    assert found(spark, rows + rows[:7]) == want  # deliveries again change nothing


def test_pairs_are_of_neighbouring_turns(spark):
    rows = [
        (1, 0, "system", "x"), (1, 1, " Human ", Q), (1, 2, "GPT", FULL), (1, 3, "user", Q), (2, 0, "user", Q), (2, 1, "user", Q), (2, 2, "model", FULL), (3, 0, "user", Q), (3, 2, "assistant", FULL),
        (None, 0, "user", Q), (4, None, "user", Q), (5, 0, None, Q), (6, 0, "user", None), (6, 1, "assistant", FULL), (7, 0, "assistant", ""), (8, 0, "user", "word " * 200_000), (8, 1, "assistant", "so " * 100_000 + "it is 3."),
    ]
    assert found(spark, rows) == [(1, 3, "empty"), (2, 0, "empty"), (3, 0, "empty")]
    assert found(spark, []) == []


def test_counts_add_up(spark):
    rows = [(i, k, t, r, c, None, None, None) for i, (k, t, r, c) in enumerate([(1, 0, "user", Q), (1, 1, "assistant", FULL), (2, 0, "user", Q)])]
    got = {r.defect: r.n_pairs for r in pairs.defect_counts(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {"none": 1, "empty": 1}


def alnum(c):
    return c.isalpha() or c.isnumeric()


def all_pairs(rows):
    """The two kinds of shortened texts by comparing every two rows."""
    within, own = set(), set()
    for q, t in rows:
        for q2, t2 in rows:
            if len(t2) > len(t) and t2.startswith(t):
                inside = alnum(t2[len(t)])
                if inside and t[-1].isalpha() and len(words(t)) >= pairs.WORDS_TO_TELL:
                    within.add(t)
                if q == q2 and not (inside and t[-1].isnumeric()):
                    own.add((q, t))
    return within, own


def shortened(spark, rows, parts=7):
    df = spark.createDataFrame([(q, f"id of {t}", t) for q, t in rows], "q string, id string, text string").repartition(parts)
    within, own = pairs.shortened(df)
    return {r.id[6:] for r in within.collect()}, {(r.q, r.id[6:]) for r in own.collect()}


def test_shortened_texts_against_all_pairs(spark):
    rng = random.Random(4)
    full = [" ".join(rng.choice(["alpha", "beta", "gamma", "7", "72", "delta."]) for _ in range(12)) for _ in range(40)]
    cuts = [t[: rng.randint(1, len(t) - 1)] for t in full for _ in range(3)]
    rows = {(rng.choice("qrs"), t.rstrip()) for t in full + cuts for _ in range(2)} | {("q", full[0]), ("r", full[0] + " more"), ("s", full[0] + "alas")}
    rows |= {("q", "é" * k) for k in range(1, 9)} | {("r", "one two three fo\U0010ffff"), ("r", "one two three fo"), ("s", "one two three four")}
    assert shortened(spark, rows) == all_pairs(rows)
    assert shortened(spark, []) == (set(), set())


def test_rows_between_hide_no_longer_version(spark):
    t = "It is what we look at fir"
    rows = [("q1", t), ("q2", t), ("q1", t + "st of all."), ("q3", t + "."), ("q3", t + ", then")]
    assert shortened(spark, rows) == all_pairs(rows) == ({t}, {("q1", t)})
    answers = [FULL[: FULL.index(". T") + 1], FULL, "It is 12. Then", "It is 12. Then - hm."]
    messages = [m for k, a in enumerate(answers) for m in ((k, 0, "user", Q), (k, 1, "assistant", a))]
    assert found(spark, messages) == [(0, 0, "truncated"), (2, 0, "truncated")]
    steps = pairs.truncation_steps(spark.createDataFrame([(i, *m, None, None, None) for i, m in enumerate(messages)], MESSAGES))
    assert {r.step: r.n_pairs for r in steps.collect()} == {"prefix": 2}


def test_length_limits(spark):
    rows = [(f"a{i}", 100) for i in range(90)] + [(f"b{x}.{k}", x) for x in range(64, 160) for k in range(2)] + [("same", 30)] * 500 + [(f"c{i}", 4000) for i in range(7)] + [(f"d{i}", 5000) for i in range(5)]
    assert sorted(r.n_chars for r in pairs.length_limits(spark.createDataFrame(rows, "id string, n_chars int")).collect()) == [100, 4000]


def test_answers_at_a_length_limit(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(60)]
    cut = [t + f"\nResult: 4{x}".ljust(13, "m") for t, x in zip(texts[:30], range(10, 40))]  # ends in a result and a unit, at one length
    whole = [t + f"\nResult: 4{'1' * (1 + k % 9)} mm" for k, t in enumerate(texts[30:])]
    rows = [m for k, a in enumerate(cut + whole) for m in ((k, 0, "user", f"What is {k}?"), (k, 1, "assistant", a))]
    assert not [r for r in found(spark, rows) if r[2] == "truncated"]  # a result is an answer, at whatever length
    rows = [m for k, a in enumerate([t + " and th" for t in texts[:30]] + whole) for m in ((k, 0, "user", f"What is {k}?"), (k, 1, "assistant", a))]
    steps = pairs.truncation_steps(spark.createDataFrame([(i, *m, None, None, None) for i, m in enumerate(rows)], MESSAGES))
    assert {r.step: r.n_pairs for r in steps.collect()} == {"limit": 30}


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(50, None), (51, ""), (52, "a b c"), (None, "x " * 20), (53, items_text := " ".join(["the"] * 40))]
    docs = []
    for d in range(200):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            src = words(rng.choice(items[:30])[1])
            a, n = rng.randint(0, 10), rng.randint(8, 30)
            ws[5:5] = src[a : a + n]
            ws += words(rng.choice(items[:30])[1])[:20]
        docs.append((d, rng.choice([" ", ", ", "\n", " - "]).join(ws).upper() if d % 3 else "  ".join(ws), "clash"))
    docs += [(500, None, ""), (501, "", ""), (None, items_text, ""), (502, "the " * 20_000, ""), (503, items_text, "")]
    grams = {}
    for i, t in items:
        for k in range(len(words(t)) - 12):
            grams.setdefault(tuple(words(t)[k : k + 13]), set()).add(i)
    want = {(d, i) for d, t, _ in docs if d is not None for k in range(len(words(t)) - 12) for i in grams.get(tuple(words(t)[k : k + 13]), ()) if i is not None}
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, problem string")
    got = [(r.doc_id, r.item_id) for r in tiling.leaks(dd, ii).collect()]
    assert sorted(got) == sorted(want)
    assert tiling.leaks(dd, ii.where("false")).count() == tiling.leaks(dd.where("false"), ii).count() == 0


def test_reordered_passages_are_tiled():
    item = tiling.encoded([f"w{i}" for i in range(60)])
    doc = tiling.encoded([f"w{i}" for i in range(30, 60)] + ["other"] + [f"w{i}" for i in range(30)] + [f"w{i}" for i in range(20)])
    assert sorted(tiling.tiles(doc, item)) == [(0, 30, 30), (31, 0, 30)]
    assert tiling.tiles(doc[:12], item) == []
    same = tiling.encoded(["the"] * 3000)  # every two windows match
    assert tiling.tiles(same, same[:300])[0] == (0, 0, 300) and tiling.tiles(same, same) == [(0, 0, 3000)]


def brute_tiles(doc, item, least):
    """The definition: again and again the longest match of unmarked words, the first in the document."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while p + n < len(doc) and j + n < len(item) and doc[p + n] == item[j + n] and doc[p + n] and p + n not in used_d and j + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, p, j)
        n, p, j = best
        if n < least:
            return out
        out.append((p, j, n))
        used_d |= set(range(p, p + n))
        used_i |= set(range(j, j + n))


def test_tiles_against_their_definition():
    rng = random.Random(11)
    for _ in range(150):
        word = lambda: rng.choice([0, 1, 2, 3])
        doc, item = [word() for _ in range(rng.randint(0, 30))], [word() for _ in range(rng.randint(0, 20))]
        got = tiling.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert got == brute_tiles(doc, item, 3)


def test_a_passage_in_most_documents_and_many_items(spark, monkeypatch):
    run = " ".join(f"common{k}" for k in range(15))
    items = spark.createDataFrame([(i, f"item{i} {run} of {i}") for i in range(40)] + [(99, "nothing " * 12)], "item_id bigint, problem string")
    docs = spark.createDataFrame([(d, f"{d} says: {run}, so" if d % 3 else f"doc {d} " * 9) for d in range(900)], "doc_id bigint, text string")
    monkeypatch.setattr("planloom.llm.skew.HOT_ROWS", 50)
    monkeypatch.setattr("planloom.llm.skew.hot_keys.__defaults__", (50,))
    monkeypatch.setattr("planloom.llm.skew.salted.__defaults__", (50,))
    monkeypatch.setattr(tiling, "MOST_BITS", 16)  # a map that lets other windows pass too
    got = tiling.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in range(900) if d % 3 for i in range(40)} and len(got) == 600 * 40
    assert all((r.n_tiles, r.longest, r.matched_words, r.item_words) == (1, 15, 15, 18) and r.coverage == pytest.approx(15 / 18) for r in got)


PROSE = "The ledger lists 56 seedlings after the opening. Nobody remembers such a busy season, and the road is closed. How many are left when all this is done?"
FORMS = {
    PROSE: "prose",
    PROSE.replace(" ", "\n"): "prose",
    "\n".join(PROSE.split(". ")) + "\n- one item\n- two items\n- three items": "prose",
    "Im Lager liegen 52 Fässer, und Mara bewacht sie. Danach kommen noch 8 dazu, weil der Wagen spät ist.": "prose",
    "- 12 red jars\n- 5 blue rods\n- 675 kettles\n- 9 ropes": "list",
    "red jar;\nblue rod;\ngreen kettle;\nold rope;\nnew bell;": "list",
    "1) fix the height of L1\n2) rename the rate of L2\n3) count the loss of L3": "list",
    "a | b | c\n---|---|---\n1 | 2 | 3\n4 | 5 | 6": "table",
    "cost,gain,pay\n1,2,3\n4,,6\n7,8,n/a": "table",
    "a\tb\tc\n1\t2\t3\n4\t5\t6": "table",
    "speed   rate  load\n40      54    6\n7189    36    58\n654     45    98": "table",
    "step step\n" * 12: "junk",
    "bvfwghsjkq trmcwdpcjbpk fhzfm wcxlnqhwmgkn xfv gvlzd zrshrzzjpqxsj cmpnp": "junk",
    "00000000  21 43 9c 7e 60 08 2f c4\n00000010  ef fc d1 19 d7 4c 1b aa\n00000020  d2 d9 4f 62 eb a1 92 2c": "junk",
    "Home > Back > Next > Top > Print > Search > Login > Help > Home > Back > Share": "junk",
    "#@-|7;%6!%1*41+$5>~@%%#0%5|1!_|$1@.@^_~%|31|438*@>$@~/#^@/^": "junk",
    "": "junk",
    None: "junk",
}


def test_forms_of_texts(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(FORMS)] + [(None, "x", "")], "doc_id bigint, text string, form string")
    got = {r.doc_id: r.form for r in quality.text_quality(df).collect()}
    wrong = {list(FORMS)[i]: f for i, f in got.items() if f != list(FORMS.values())[i]}
    assert not wrong and len(got) == len(FORMS)
    assert {r.doc_id for r in quality.not_prose(df).collect()} == {i for i, f in got.items() if f != "prose"}
    assert quality.text_quality(df.where("false")).count() == 0


def test_statistics():
    s = quality.statistics("One two.\n\nOne two.\nand 3!")
    assert (s["n_words"], s["n_lines"], s["punctuated_lines"]) == (6, 3, 1.0) and s["duplicate_lines"] == pytest.approx(1 / 3)
    assert s["mean_word_length"] == pytest.approx(16 / 6) and s["symbol_ratio"] == pytest.approx(3 / 19)
    long = quality.statistics("word " * 100_000)
    assert long["n_words"] == 100_000 and long["top_ngram_chars"] == 1.0 and quality.form(long) == "junk"


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, PROSE), (1, PROSE)], "doc_id bigint, text string")
    assert quality.text_quality(df).count() == 2 and df.select(F.count("*")).first()[0] == 2
