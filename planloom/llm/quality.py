"""Problem 8: per-document text statistics, and from them whether a text is prose, a list, a table or junk.

One pass over the texts, without a shuffle: each batch gets its statistics and a combined rule. Besides counts of words,
symbols, punctuated lines and common words there are repetition statistics (shares of repeated lines and paragraphs,
share of characters under the most frequent word n-gram), which tell boilerplate from what is merely long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of the languages present, by language.
COMMON = {
    "en": "the of and to in is a that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now people my made over did down only way find use may long after also most where before are because",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde dann wenn wir ihr viele im",
    "fr": "le la les de des du un une et est dans en que qui pour pas sur au avec il elle ce se ne par plus sont on nous vous mais ou comme tout son sa ses cette été aux deux bien même y a leur si donc dont entre sans combien",
    "es": "el la los las de del un una y es en que por para con no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese cuántos cuántas tiene",
    "it": "il lo la i gli le di del della un una e è in che per con non si al come più ma sono da anche dei nel alla ha",
    "nl": "de het een van en is in dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door naar hoeveel",
    "pt": "o a os as de do da um uma e é em que por para com não se ao como mais mas são no na dos das foi",
}
_COMMON = frozenset(w for ws in COMMON.values() for w in ws.split())

_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_MARK = re.compile(r"^\s*(?:[-*+•–—·▪◦‣○●►✓]|\[[ xX✓]?\]|[☐☑]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.):])\s+\S")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’)\]»]*(?=\s|$)")
_LINE_END = re.compile(r"[.!?。！？…:;,][\"'”’)\]»]*\s*$")
_STOP_END = re.compile(r"[.!?。！？…][\"'”’)\]»]*\s*$")
_SPACED = re.compile(r"(?:\t|  +)")
_BROKEN = regex.compile(r"[ÃÂâ€™¢£¤¥¦§¨ª«¬¯°±²³´µ¶·¸¹º»¼½¾¿ï�\p{C}--[\n\r\t]]", regex.V1)
_MIXED = regex.compile(r"\p{Ll}\p{Lu}|\p{N}\p{L}|\p{L}\p{N}.*\p{L}")
_BLANK_LINE = re.compile(r"\n\s*\n")
_VOWELS = regex.compile(r"[aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüœ]", regex.I)
_HEX = re.compile(r"^(?=[^\W\d]*\d)(?=\d*[^\W\d])[0-9a-fA-F]{2,16}$")
_DUMP = re.compile(r"^\s*(?:0x)?[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2,8}\s+){4,}")
_SEGMENT = re.compile(r"[.!?。！？…;,\n]+")
_RULE = re.compile(r"[\s|+:=\-–—]{3,}")

FIELDS = {
    "n_words": "bigint", "n_lines": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "punctuated_lines": "double",
    "common_words": "double", "duplicate_lines": "double", "duplicate_paragraphs": "double", "duplicate_segments": "double", "top_ngram_chars": "double", "distinct_words": "double",
    "marked_lines": "double", "marked_words": "double", "dump_lines": "double", "row_lines": "double", "broken_chars": "double", "odd_words": "double", "sentences": "bigint", "words_per_line": "double", "short_lines": "double", "short_words": "double",
}
SCHEMA = "doc_id bigint, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", form string, rule string"


def _cells(line: str, sep: str) -> int:
    if sep == "  ":
        return len(_SPACED.split(line.strip()))
    if sep == "|":
        return len(line.strip().strip("|").split("|"))
    return len(line.split(sep))


def rows_share(lines: list[str]) -> float:
    """Share of the lines that are rows of one table: the same number of short cells between one separator."""
    rules = sum(1 for x in lines if _RULE.fullmatch(x))
    body = [x for x in lines if not _RULE.fullmatch(x)]
    if len(body) < 3:
        return 0.0
    best = 0.0
    text = "\n".join(body)
    for sep in ("\t", "|", ";", ",", "  "):
        if sep not in text and not (sep == "  " and "\t" in text):
            continue
        if sep in ";,":  # an item's closing mark parts no cells
            ends = sum(1 for x in body if x.rstrip().endswith(sep))
            counts = [_cells(x.rstrip().removesuffix(sep), sep) for x in body] if ends > 0.6 * len(body) else [_cells(x, sep) for x in body]
        else:
            counts = [_cells(x, sep) for x in body]
        common = Counter(c for c in counts if c >= 2)
        if not common:
            continue
        width, n = common.most_common(1)[0]
        # spaces between aligned columns may run together where a cell is empty
        near = sum(1 for c in counts if c >= 2 and (abs(c - width) <= 1 if sep in ("  ", "|") else c == width))
        rows = [x for x, c in zip(body, counts) if c >= 2]
        words = sum(len(_WORD.findall(x)) for x in rows)
        cells = sum(c for c in counts if c >= 2)
        if words <= (2.2 if sep in (",", ";") else 3.5) * cells and (width >= 3 or sep != ","):
            best = max(best, (near + rules) / len(lines))
    return best


def top_ngram(words: list[str], total: int) -> float:
    """Share of the text's characters under the most frequent n-gram of 1 to 4 words that occurs at least three times."""
    best, keys = 0.0, words
    for n in (1, 2, 3, 4):
        if len(words) < 3 * n:
            break
        if n > 1:
            keys = list(map(" ".join, zip(keys, words[n - 1 :])))
        gram, count = Counter(keys).most_common(1)[0]
        if count < 3:
            break  # a longer one is no more frequent
        best = max(best, count * (len(gram) - n + 1) / max(1, total))
    return min(1.0, best)


@lru_cache(maxsize=200_000)
def _odd(word: str) -> bool:
    """Letters without a vowel or without end, hexadecimal, or letters and digits mixed."""
    if word.isalpha():
        return len(word) > 24 or len(word) >= 3 and not _VOWELS.search(word) or len(word) >= 6 and bool(_MIXED.search(word))
    return bool(_HEX.match(word)) or len(word) >= 6 and bool(_MIXED.search(word))


def statistics(text: str | None) -> dict:
    """All of ``FIELDS``; of a null or empty text zero each."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    in_line = [_WORD.findall(x) for x in lines]
    per_line = [len(x) for x in in_line]
    words = [w for x in in_line for w in x]
    low = " ".join(words).lower().split(" ") if words else []
    paragraphs = [p.strip() for p in _BLANK_LINE.split(text) if p.strip()]
    solid = sum(map(len, text.split()))
    chars = sum(map(len, words))
    times = Counter(words)
    odd = sum(n for w, n in times.items() if _odd(w))
    div = lambda a, b: a / b if b else 0.0
    plain = text.isascii() and "".join(lines).replace("\t", "").replace("\r", "").isprintable()
    segments = [x for x in (p.strip() for p in _SEGMENT.split(text.lower())) if x]
    marked = [bool(_MARK.search(x)) for x in lines]
    return {
        "n_words": len(words),
        "n_lines": len(lines),
        "mean_word_length": div(chars, len(words)),
        "symbol_ratio": div(solid - chars, solid),
        "digit_ratio": div(sum(1 for w in words if w[0].isdigit()), len(words)),
        "punctuated_lines": div(sum(1 for x in lines if _STOP_END.search(x)), len(lines)),
        "common_words": div(sum(1 for w in low if w in _COMMON), len(words)),
        "duplicate_lines": 1 - div(len({x.strip().lower() for x in lines}), len(lines)) if lines else 0.0,
        "duplicate_paragraphs": 1 - div(len(set(paragraphs)), len(paragraphs)) if paragraphs else 0.0,
        "duplicate_segments": 1 - div(sum(map(len, set(segments))), sum(map(len, segments))) if segments else 0.0,
        "top_ngram_chars": top_ngram(low, chars),
        "distinct_words": div(len(set(low)), len(low)),
        "marked_lines": div(sum(marked), len(lines)),
        "marked_words": div(sum(n for n, m in zip(per_line, marked) if m), len(words)) if any(marked) else 0.0,
        "dump_lines": div(sum(1 for x in lines if _DUMP.search(x)), len(lines)),
        "row_lines": rows_share(lines),
        "broken_chars": 0.0 if plain else div(len(_BROKEN.findall(text)), solid),
        "odd_words": div(odd, len(words)),
        "sentences": len(_SENTENCE_END.findall(text)),
        "words_per_line": div(len(words), len(lines)),
        "short_lines": div(sum(1 for n in per_line if n <= 5), len(lines)),
        "short_words": div(sum(n for n in per_line if n <= 5), len(words)),
    }


#: Share of repeated lines or paragraphs from which on prose is boilerplate.
BOILERPLATE = 0.3


def judged(s: dict) -> tuple[str, str]:
    """The form of a text and the rule that decides it, by the rules on ``statistics`` in this order.

    Repetition makes junk where one thing is said over and over: the most frequent n-gram, repeated segments, lines or
    paragraphs. Where it is less, prose stays prose, but is told as boilerplate.
    """
    n, lines = s["n_words"], s["n_lines"]
    if n == 0:
        return "junk", "no words"
    marked = lines >= 3 and s["marked_lines"] >= 0.5 and s["marked_words"] >= 0.5
    if marked and s["broken_chars"] < 0.05 and s["top_ngram_chars"] <= 0.5 and s["duplicate_segments"] <= 0.6 and s["duplicate_paragraphs"] <= 0.8:
        return "list", "marks"
    if s["broken_chars"] > 0.08:
        return "junk", "broken characters"
    if s["dump_lines"] > 0.5:
        return "junk", "dump"
    if s["odd_words"] > 0.4 and s["common_words"] < 0.12 and s["row_lines"] < 0.6:
        return "junk", "odd words"
    if s["row_lines"] >= 0.6 and lines >= 3 and not s["duplicate_lines"] > 0.8:
        return "table", "rows"
    if s["symbol_ratio"] > 0.45 and s["common_words"] < 0.1:
        return "junk", "symbols"
    if n >= 6 and (s["top_ngram_chars"] > 0.5 or s["duplicate_segments"] > 0.6 and n >= 12 or max(s["duplicate_lines"], s["duplicate_paragraphs"]) > 0.8 and lines >= 5):
        return "junk", "repetition"
    per_sentence = n / max(1, s["sentences"])
    broken_prose = s["words_per_line"] < 1.5 and s["common_words"] >= 0.2  # a word to a line
    if lines >= 3 and s["words_per_line"] <= 7 and s["short_lines"] >= 0.5 and s["short_words"] >= 0.4 and not broken_prose and (s["sentences"] <= 0.3 * lines or s["words_per_line"] <= 4):
        return "list", "short lines"
    if s["common_words"] < 0.08 and (per_sentence > 25 or s["sentences"] == 0):
        return "junk", "no sentences"
    return "prose", "boilerplate" if max(s["duplicate_lines"], s["duplicate_paragraphs"]) > BOILERPLATE else "sentences"


def form(s: dict) -> str:
    """prose, list, table or junk; see ``judged``."""
    return judged(s)[0]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b["doc_id"], b["text"]):
            s = statistics(text)
            rows.append((doc_id, *s.values(), *judged(s)))
        yield pd.DataFrame(rows, columns=["doc_id", *FIELDS, "form", "rule"])


def text_quality(documents: DataFrame) -> DataFrame:
    """``FIELDS``, form and the rule that decides it of each document (doc_id, text); rows with a null id are left out, repeated rows stay repeated."""
    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(_rows, SCHEMA)


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "form": [form(statistics(t)) for t in b["text"]]})


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id, form) of the documents that are a list, a table or junk, by the rules of ``text_quality``."""
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    return docs.mapInPandas(_forms, "doc_id bigint, form string").where(F.col("form") != "prose")


def rule_counts(documents: DataFrame) -> DataFrame:
    """(form, rule, n_docs, mean_words): how many documents each rule decides, and how long they are."""
    return text_quality(documents).groupBy("form", "rule").agg(F.count("*").alias("n_docs"), F.avg("n_words").alias("mean_words"))


def label_agreement(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(half, n, n_agree): how many labelled documents get their label, in both halves of the labels by a hash of the document's id.

    Of several labels of a document the first in order counts; null and unknown ones are left out.
    """
    named = labels.select("doc_id", F.lower(F.trim("form")).alias("label")).where("label in ('prose', 'list', 'table', 'junk') and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    j = text_quality(documents.join(named.select("doc_id"), "doc_id", "left_semi")).select("doc_id", "form").join(named, "doc_id")
    half = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("bigint") % 2
    return j.groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.count_if(F.col("form") == F.col("label")).alias("n_agree"))
