"""Quantities, answers and their comparison, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in a problem's text (fixed value).
NUMBER = r"[\d,]+\.?\d*"


def _finite(c: Column) -> Column:
    return F.nullif(F.nullif(F.nullif(c, F.lit(float("nan"))), F.lit(float("inf"))), F.lit(float("-inf")))


def to_number(text: Column) -> Column:
    """A text as a double, without its commas; NULL if it is none."""
    return _finite(F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def quantity_matches(text: Column) -> Column:
    """Every match of ``NUMBER`` in its order, matches without a digit too (they keep their index)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def quantities(text: Column) -> Column:
    """ARRAY<STRUCT<qid, value, span>>: numbers of a text, named q and the index of the match; gaps where a match is no number."""
    every = F.transform(quantity_matches(text), lambda m, i: F.struct(F.concat(F.lit("q"), i.cast("string")).alias("qid"), to_number(m).alias("value"), m.alias("span")))
    return F.filter(every, lambda q: q["value"].isNotNull())


def quantity_map(text: Column) -> Column:
    """MAP<qid, value>."""
    return F.map_from_entries(F.transform(quantities(text), lambda q: F.struct(q["qid"], q["value"])))


def numbers(text: Column) -> Column:
    """The numbers of a text without gaps."""
    return F.transform(quantities(text), lambda q: q["value"])


def positional_bindings(slots: Column, text: Column) -> Column:
    """MAP<slot, value>: the i-th slot gets the i-th match; 0 where there is none or it is no number. Of slots of one name the last counts."""
    found = quantity_matches(text)
    pairs = F.transform(slots, lambda s, i: F.struct(s["name"].alias("k"), F.coalesce(to_number(F.get(found, i)), F.lit(0.0)).alias("v")))
    named = F.filter(pairs, lambda p: p["k"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(named, lambda p: p["k"] == n), -1)["v"]))


def indexed_bindings(text: Column) -> Column:
    """MAP<x0.., value> of the numbers of a text."""
    nums = numbers(text)
    return F.map_from_arrays(F.transform(nums, lambda _, i: F.concat(F.lit("x"), i.cast("string"))), nums)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


#: Where an answer stands in a text, by rule; the first pattern that is found counts (fixed values).
ANSWER_RULES = {
    "eval": (r"(?imd)####\s*([\-\d,]+\.?\d*)", r"(?imd)\\boxed\{([^}]+)\}", r"(?imd)(?:the answer is|answer:)\s*\$?\s*([\-\d,]+\.?\d*)", r"(?imd)=\s*([\-\d,]+\.?\d*)\s*$", r"(?imd)([\-\d,]+\.?\d*)\s*$"),
    "algebra": (r"(?:the answer is|answer:|=)\s*\$?\\?boxed\{([^}]+)\}", r"(?:the answer is|answer:|=)\s*\$?\s*([\d,]+\.?\d*)", r"####\s*([\d,]+\.?\d*)", r"(\d[\d,]*\.?\d*)\s*$"),
    "distill": (r"####\s*([\-\d,]+\.?\d*)", r"\\boxed\{([^}]+)\}", r"(?i)(?:the answer is|answer:)\s*\$?\s*([\-\d,]+\.?\d*)", r"([\-\d,]+\.?\d*)\s*$"),
}
_STRIP = r"^\s+|\s+$"


def extract_answer(text: Column, rule: str = "eval") -> Column:
    """The answer that a text states, by the cascade of ``rule``, without commas; NULL if it states none.

    The rule 'algebra' looks at the text in lower case and falls back to its last line.
    """
    bare = F.regexp_replace(text, _STRIP, "")
    looked_at = F.lower(bare) if rule == "algebra" else bare
    out = F.when(F.lit(False), F.lit(""))
    for p in ANSWER_RULES[rule]:
        out = out.when(looked_at.rlike(p), F.regexp_replace(F.replace(F.regexp_extract(looked_at, p, 1), F.lit(","), F.lit("")), _STRIP, ""))
    if rule == "algebra":
        out = out.otherwise(F.regexp_replace(F.element_at(F.split(bare, "\n"), -1), _STRIP, ""))
    return out


def gold_answer(answer: Column, solution: Column) -> Column:
    """The answer of a record: its own, else what its solution has in a box, behind the last ####, or as its last number; '' if nothing."""
    nums = F.regexp_extract_all(solution, F.lit(r"[\-\d,]+\.?\d*"), F.lit(0))
    boxed = r"\\boxed\{([^}]+)\}"
    found = (
        F.when(solution.rlike(boxed), F.regexp_extract(solution, boxed, 1))
        .when(F.contains(solution, F.lit("####")), F.element_at(F.split(solution, "####"), -1))
        .when(F.size(nums) > 0, F.replace(F.try_element_at(nums, F.lit(-1)), F.lit(","), F.lit("")))
    )
    return F.regexp_replace(F.coalesce(F.nullif(answer, F.lit("")), found, F.lit("")), _STRIP, "")


def normal_answer(text: Column) -> Column:
    """An answer without marks, commas, currency and percent signs; numbers in their shortest form, others in lower case."""
    bare = F.coalesce(_first(text, r"\\boxed\{([^}]*)\}"), _first(text, r"####\s*([^\n]+)"), F.trim(text))
    plain = F.trim(F.regexp_replace(bare, r"[,$%]", ""))
    number = _finite(plain.try_cast("double"))
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(number.isNotNull(), F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))).otherwise(F.lower(plain))


#: Rules by which a predicted answer matches the expected one:
#: (relative tolerance or None, absolute tolerance, absolute only near gold 0, strings: 'exact', 'lower' or None) (fixed values).
MATCH_RULES = {
    "AM-1": (1e-3, 1e-3, "exact"),
    "AM-2": (1e-3, 1e-3, "lower"),
    "AM-3": (1e-2, 1e-3, "lower"),
    "AM-4": (1e-2, 1e-3, "exact"),
    "AM-5": (None, 1e-3, "lower"),
    "AM-6": (None, 1e-3, "normal"),
    "AM-7": ("max1", 1e-3, None),
    "AM-8": (None, 1e-3, "lower"),
    "AM-9": ("hint", 1e-3, "exact"),
}


def answers_match(predicted: Column, gold: Column, rule: str) -> Column:
    """Whether two answers (texts) match by a rule; a null on either side or an empty gold doesn't match."""
    rel, least, strings = MATCH_RULES[rule]
    if rule == "AM-5":  # what the expected text states, if it states anything
        gold = F.coalesce(F.nullif(extract_answer(gold), F.lit("")), gold)
    p, g = to_number(F.trim(predicted)), to_number(F.trim(gold))
    gap = F.abs(p - g)
    if rel is None:
        numeric = gap < least
    elif rel == "max1":
        numeric = gap < least * F.greatest(F.abs(g), F.lit(1.0))
    elif rel == "hint":
        numeric = gap < F.greatest(0.01 * F.abs(g), F.lit(least))
    else:
        numeric = F.when(g == 0, gap < least).otherwise(gap < rel * F.abs(g))
    text = {
        "exact": F.trim(predicted) == F.trim(gold),
        "lower": F.lower(F.trim(predicted)) == F.lower(F.trim(gold)),
        "normal": normal_answer(predicted) == normal_answer(gold),
        None: F.lit(False),
    }[strings]
    both = p.isNotNull() & g.isNotNull()
    return F.coalesce((F.trim(gold) != "") & F.when(both, numeric).otherwise(text), F.lit(False))


def template_key(text: Column, anchors: tuple[str, ...]) -> Column:
    """At most four anchor words of a text, else its first two words, sorted, without repeats and joined by '|'; of a text without words 'misc'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.filter(F.array(*map(F.lit, anchors)), lambda a: F.contains(low, a))
    first = F.slice(F.regexp_extract_all(low, F.lit(r"[a-z]+"), F.lit(0)), 1, 2)
    key = F.array_join(F.slice(F.array_sort(F.array_distinct(F.when(F.size(hits) > 0, hits).otherwise(first))), 1, 4), "|")
    return F.when(key != "", key).otherwise("misc")


def renamed(expr: Column, names: dict[str, str]) -> Column:
    """An expression with whole words renamed, longest names first, one after the other."""
    out = expr
    for k in sorted(names, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, rf"\b{k}\b", names[k])
    return out


def filled(expression: Column, bindings: Column) -> Column:
    """``{name}`` in a template's text replaced by the text that MAP ``bindings`` has for the name."""
    return F.aggregate(F.map_entries(bindings), expression, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def rendered(problem: Column, answer: Column) -> Column:
    """A training text: the problem, then the answer with its mark unless it has one already."""
    marked = F.when(F.contains(answer, F.lit("####")), answer).otherwise(F.concat(F.lit("#### "), answer))
    return F.concat(F.lit("Problem: "), problem, F.lit("\n\n"), marked)
