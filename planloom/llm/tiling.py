"""Problem 6: passages of held-out texts inside the documents of a corpus, by greedy string tiling.

Words become 64-bit codes, and every window of ``MIN_MATCH`` words gets two hashes of 64 bits, rolled as Karp and Rabin
do: the first is what windows are joined by, the second confirms it. Windows of items are the seeds. A document's windows
are looked up in a bit map of the seeds first, whose size has a fixed upper bound whatever there is of items, so what
is shuffled of the corpus is little more than the windows that are seeds; of a document with one, the words in such
windows are kept. The seeds of both sides are joined by their hash, windows that are in very many documents spread over
salts. Of each document and item that share a window, the longest non-overlapping matches of the kept words are marked,
again and again, until none of ``MIN_MATCH`` words is left: tiles are found in whatever order the passages come.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.skew import salted
from planloom.session import cut

#: Fewest consecutive words that count as a passage.
MIN_MATCH = 13
#: Bits of the map of seeds: so many for each seed, between these powers of two. The upper one is 16 MiB. A seed sets two.
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 256, 16, 27
_WORD = re.compile(r"[^\W_]+")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

SCHEMA = "doc_id bigint, item_id bigint, n_tiles bigint, longest bigint, matched_words bigint, item_words bigint"


def tokens(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1 | 1  # positive, never 0


def encoded(words: list[str]) -> np.ndarray:
    """Codes of words; 0 is none."""
    return np.fromiter(map(_code, words), np.uint64, len(words))


def rolled(codes: np.ndarray, length: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """The hash of every window of ``length`` codes (polynomial, modulo 2**64)."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    x = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    out = np.zeros(len(codes) - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * base + x[k : k + len(out)]
    return out ^ (out >> np.uint64(31))


def _starts(doc: np.ndarray, item: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(p, j) where a run of equal words of ``least`` or more begins: the windows match and the words before don't.

    Of a window's places in both texts, those with the same word before are left out as a group, so texts that repeat one
    word have few starts although every two of their windows match.
    """
    at_doc, at_item = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
    item_hashes = rolled(item, least)
    for j, h in enumerate(item_hashes.tolist()):
        at_item[h][int(item[j - 1]) if j else -1].append(j)
    hashes = rolled(doc, least)
    for p in np.flatnonzero(np.isin(hashes, item_hashes)).tolist():
        at_doc[int(hashes[p])][int(doc[p - 1]) if p else -2].append(p)
    for h, before in at_doc.items():
        for w, places in before.items():
            for v, own in at_item[h].items():
                if w != v or w == 0:
                    yield from ((p, j) for p in places for j in own)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the greedy tiling; a code of 0 matches nothing.

    Longest matches are marked first, of equally long ones the first in the document; marked words are not used again.
    """
    marked_d, marked_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    runs: list[tuple[int, int, int]] = []  # a heap of (-length, p, j)
    for p, j in _starts(doc, item, least):
        n = int(min(len(doc) - p, len(item) - j))
        same = (doc[p : p + n] == item[j : j + n]) & (doc[p : p + n] > 0)
        n = n if same.all() else int(np.argmin(same))
        if n >= least:
            runs.append((-n, p, j))
    heapq.heapify(runs)
    out: list[tuple[int, int, int]] = []
    while runs:
        n, p, j = heapq.heappop(runs)
        n = -n
        if not (marked_d[p : p + n].any() or marked_i[j : j + n].any()):
            marked_d[p : p + n] = marked_i[j : j + n] = True
            out.append((p, j, n))
            continue
        free = ~(marked_d[p : p + n] | marked_i[j : j + n])  # what is left of a run is tried again at its own length
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= least:
                heapq.heappush(runs, (a - b, p + a, j + a))
    return out


def _items(least: int):
    """Of items: their codes and the distinct hashes of their windows."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item_id, text in zip(b["item_id"], b["problem"]):
                codes = encoded(tokens(text))
                if len(codes) >= least:
                    rows.append((item_id, codes.view(np.int64), rolled(codes, least).view(np.int64), rolled(codes, least, _BASES[1]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "codes", "h", "check"])

    return encode


def _bit_map(seeds: DataFrame, n: int) -> tuple[bytes, int]:
    """A bit map of the seeds' hashes and its number of bits, which is bounded by ``MOST_BITS``."""
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_SEED * n - 1).bit_length()))
    places = (F.shiftrightunsigned("h", 64 - size), F.shiftrightunsigned("h", 64 - 2 * size).bitwiseAND(F.lit((1 << size) - 1)))
    place = F.col("place")
    parts = seeds.select(F.explode(F.array(*places)).alias("place")).groupBy(F.shiftrightunsigned(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    whole = bytearray(1 << (size - 3))
    for r in parts.toLocalIterator():  # at most 2 ** (MOST_BITS - 15) parts of 4 KiB
        whole[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    return bytes(whole), size


def _windows(bits, size: int, least: int):
    """Of documents with a window whose bit is set: the words in such windows, others as one 0, and the windows' hashes."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(bits.value, np.uint8)

        def is_set(place: np.ndarray) -> np.ndarray:
            return known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1

        for b in batches:
            words = [tokens(t) for t in b["text"]]
            ends = np.cumsum([len(w) for w in words])
            codes = np.fromiter(map(_code, chain.from_iterable(words)), np.uint64, int(ends[-1]) if len(ends) else 0)
            hashes = rolled(codes, least)
            hit = np.flatnonzero(is_set(hashes >> np.uint64(64 - size)))
            hit = hit[is_set(hashes[hit] >> np.uint64(64 - 2 * size) & np.uint64((1 << size) - 1))]
            of = np.searchsorted(ends, hit, "right")
            inside = hit + least <= ends[of] if len(hit) else np.zeros(0, bool)  # not across two documents
            hit, of = hit[inside], of[inside]
            rows = []
            for k in np.unique(of).tolist():
                start = int(ends[k]) - len(words[k])
                own = codes[start : ends[k]]
                mine = hit[np.searchsorted(of, k) : np.searchsorted(of, k, "right")] - start
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, mine, 1)
                np.add.at(edge, mine + least, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = np.where(covered, own, 0)[covered | np.concatenate(([True], covered[:-1]))]
                found, first = np.unique(hashes[mine + start], return_index=True)
                check = np.concatenate([rolled(own[m : m + least], least, _BASES[1]) for m in mine[first].tolist()])
                rows.append((b["doc_id"].iloc[k], kept.view(np.int64), found.view(np.int64), check.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "codes", "h", "check"])

    return look


def _tiled(least: int):
    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, item_id, doc, item in zip(b["doc_id"], b["item_id"], b["doc"], b["item"]):
                found = tiles(np.asarray(doc, np.int64).view(np.uint64), np.asarray(item, np.int64).view(np.uint64), least)
                if found:
                    rows.append((doc_id, item_id, len(found), max(t[2] for t in found), sum(t[2] for t in found), len(item)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return tile


def leaks(documents: DataFrame, items: DataFrame, least: int = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, matched_words, item_words, coverage) of each document and item with a tile of ``least`` words.

    documents: doc_id, text. items: item_id, problem. Null ids, null and short texts are in no row. Of several texts under
    one id, documents or items, each is compared and the best covered one counts. coverage is the share of the item's
    words in tiles. No items or no documents: no rows.
    """
    sides = "codes array<bigint>, h array<bigint>, check array<bigint>"
    wanted = cut(items.where("item_id is not null and problem is not null").select("item_id", "problem").distinct().mapInPandas(_items(least), f"item_id bigint, {sides}").withColumn("i", F.monotonically_increasing_id()))
    windows = lambda df, i: df.select(i, F.explode(F.arrays_zip("h", "check")).alias("w")).select(i, "w.h", "w.check").distinct()
    seeds = cut(windows(wanted, "i"))
    bits, size = _bit_map(seeds, seeds.count())
    look = _windows(documents.sparkSession.sparkContext.broadcast(bits), size, least)
    corpus = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    kept = cut(corpus.mapInPandas(look, f"doc_id bigint, {sides}").withColumn("d", F.monotonically_increasing_id()))
    pairs = salted(windows(kept, "d"), seeds, ["h", "check"], "d").select("d", "i").distinct()
    both = pairs.join(kept.select("d", "doc_id", F.col("codes").alias("doc")), "d").join(wanted.select("i", "item_id", F.col("codes").alias("item")), "i")
    found = both.select("doc_id", "item_id", "doc", "item").mapInPandas(_tiled(least), SCHEMA).withColumn("coverage", F.col("matched_words") / F.col("item_words"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "longest", "n_tiles", "matched_words", "item_words")).alias("t"))
    return best.select("doc_id", "item_id", *(f"t.{c}" for c in ("n_tiles", "longest", "matched_words", "item_words", "coverage")))


def leak_report(documents: DataFrame, items: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(item_id, n_docs, n_docs_covered, longest): per leaked item its documents, and those with at least ``coverage`` of its words."""
    found = leaks(documents, items)
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("coverage") >= coverage).alias("n_docs_covered"), F.max("longest").alias("longest"))
