"""Problem 2: records of the evaluation splits that also occur, exactly or almost, in the training split.

Texts that are equal but for layout form one class, so exact copies are linked through their class and never compared.
Only classes whose numbers and answer occur in the training split and in another (a group) are fingerprinted: a similarity
hash of ``BITS`` bits over their words. A block is a permuted choice of some of the bits; classes of different splits of a
group that agree in a whole block and differ in at most ``RADIUS`` bits are compared word by word.

A word that occurs c times weighs the square root of c. So two texts of which at most a fifth of the words differ have a
cosine of at least 0.8, whichever words differ, repeated ones too, and a bit differs with probability p = 0.205 or less.
A block of k bits agrees with probability (1 - p)^k; there are so many blocks that all miss a pair once in 3,000. How long
blocks are depends on the size of the group: k grows with its logarithm, so the classes that share a block stay few, and
the rows of a large group are spread over as many keys as there are values of its blocks. Small groups have short blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.functions.columns import once
from planloom.llm.words import answer_number, joined_numbers, numbers_of, words
from planloom.session import cut

BITS = 256
#: Share of the words that may be changed, added or left out, and the share of bits that differ then at most, on average.
MAX_CHANGED = 0.2
MAX_DIFFERS = math.acos(1 - MAX_CHANGED) / math.pi
#: Most bits in which the codes of two near-equal texts may differ: the mean and five standard deviations.
RADIUS = math.ceil(BITS * MAX_DIFFERS + 5 * math.sqrt(BITS * MAX_DIFFERS * (1 - MAX_DIFFERS)))
#: Chance that all blocks miss a pair of texts of which a whole fifth differs.
MISS = 1 / 3000
#: Bits of a block at least and at most, and bits added each time that a group is twice as large.
SHORTEST, LONGEST, BITS_PER_DOUBLING = 5, 28, 1.0
TRAIN, EVAL = "train", ("dev", "test")

#: Normal deviates by byte: a word's direction is drawn from them, so that angles between texts come out exactly.
_NORMAL = np.array([NormalDist().inv_cdf((i + 0.5) / 256) for i in range(256)], np.float32)


@lru_cache(maxsize=100_000)
def _direction(word: str) -> np.ndarray:
    raw = word.encode("utf-8", "surrogatepass")
    return np.frombuffer(b"".join(hashlib.blake2b(raw, digest_size=64, salt=bytes([i])).digest() for i in range(BITS // 64)), np.uint8)


def simhash(tokens: list[str]) -> np.ndarray:
    """The bits of a text's similarity hash; of no words, all zero."""
    if not len(tokens):
        return np.zeros(BITS, np.uint8)
    counts: dict[str, int] = {}
    for w in tokens:
        counts[w] = counts.get(w, 0) + 1
    total = np.zeros(BITS, np.float32)
    names, weights = list(counts), np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    for at in range(0, len(names), 4096):
        total += weights[at : at + 4096] @ _NORMAL[np.stack([_direction(w) for w in names[at : at + 4096]])]
    return (total > 0).astype(np.uint8)


def block_bits(group: int) -> int:
    """Bits of a block in a group of so many classes."""
    return int(min(LONGEST, SHORTEST + BITS_PER_DOUBLING * math.log2(max(1, group / 8))))


def block_count(bits: int) -> int:
    """So many blocks of ``bits`` bits that all of them miss a pair with chance ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-((1 - MAX_DIFFERS) ** bits)))


@lru_cache(maxsize=64)
def _blocks(bits: int) -> np.ndarray:
    """The bits of each block, one row a block: cut from as many permutations of all bits as are needed."""
    rng, rows = np.random.default_rng([bits, 2]), []
    while len(rows) < block_count(bits):
        rows += list(rng.permutation(BITS)[: BITS // bits * bits].reshape(-1, bits))
    return np.array(rows[: block_count(bits)])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for bits, part in b.groupby("bits"):
            code = np.stack([simhash(w) for w in part["words"]])
            packed = np.packbits(code, axis=1, bitorder="little").view(np.int64)
            values = code[:, _blocks(bits)].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
            yield pd.DataFrame({"class_id": part["class_id"], "key": part["key"], "side": part["side"], "code": list(packed), "blocks": list(values)})


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most ``most`` words must be changed, added or left out to make one text the other.

    The columns of the distance table are bit vectors as long as the first text, so a column costs a few operations on
    long integers.
    """
    if abs(len(a) - len(b)) > most:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if not a or not b:
        return max(len(a), len(b)) <= most
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    for left, w in zip(range(len(b) - 1, -1, -1), b):
        same = at.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        grows, falls = down | (every & ~(diagonal | up)), up & diagonal
        score += bool(grows & last) - bool(falls & last)
        if score - left > most:  # each word that is left lowers the distance by one at most
            return False
        grows, falls = (grows << 1 | 1) & every, falls << 1 & every
        up, down = falls | (every & ~(same | down | grows)), grows & (same | down)
    return score <= most


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within(list(x), list(y), int(MAX_CHANGED * max(len(x), len(y)) + 1e-9)) for x, y in zip(a, b)], dtype=bool)


def split_name(c: Column) -> Column:
    """A split as it is spelled here, whatever its case and the blanks around it; NULL for null and unknown ones."""
    plain = F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))
    return F.when(plain.isin(TRAIN, *EVAL), plain)


def records(df: DataFrame) -> DataFrame:
    """(item_id, split, source, key, text_key, words): rows that can be in a pair, deliveries again once.

    Rows with a null id, split, problem or answer, or with an answer that is no number, are in no pair. key is the hash
    of the numbers and the answer, text_key that of words, numbers and answer.
    """
    kept = df.select("item_id", split_name(F.col("split")).alias("split"), "source", "problem", "answer")
    kept = kept.where("item_id is not null and split is not null and problem is not null and answer is not null")
    single = kept.groupBy("item_id").agg(F.min(F.struct("split", "source", "problem", "answer")).alias("r")).select("item_id", "r.*")
    plain = once(single, joined=joined_numbers(F.col("problem")), given=answer_number(F.col("answer"))).where("given is not null")
    out = once(plain, words=words(F.col("joined")), said=F.concat_ws(" ", "given", F.lit("|"), F.concat_ws(" ", numbers_of(F.col("joined")))))
    return out.select(
        "item_id",
        "split",
        "source",
        F.md5("said").alias("key"),
        F.md5(F.concat_ws(" ", "said", F.lit("|"), F.concat_ws(" ", "words"))).alias("text_key"),
        "words",
    )


def linked_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes of the training split and of the others, and members (class_id, item_id, split, source).

    A class is a text on one side; its id is the smallest of its rows. Each pair of classes that belongs together is one
    link, however many copies either has, so the output isn't expanded.
    """
    rows = cut(records(df))
    is_train = F.col("split") == TRAIN
    classes = rows.groupBy("key", "text_key", is_train.alias("side")).agg(F.min(F.struct("item_id", "words")).alias("r"))
    sizes = classes.groupBy("key").agg(F.max("side").alias("t"), F.max(~F.col("side")).alias("e"), F.count("*").alias("n")).where("t and e")
    bits = F.lit(SHORTEST)
    for k in range(SHORTEST + 1, LONGEST + 1):  # the smallest group that has blocks of k bits
        bits = F.when(F.col("n") >= math.ceil(8 * 2 ** ((k - SHORTEST) / BITS_PER_DOUBLING)), k).otherwise(bits)
    sides = cut(classes.join(sizes.select("key", bits.alias("bits")), "key").select(F.col("r.item_id").alias("class_id"), "key", "text_key", "side", "bits", F.col("r.words").alias("words")))

    same = sides.groupBy("text_key").agg(F.min(F.when(F.col("side"), F.col("class_id"))).alias("a"), F.min(F.when(~F.col("side"), F.col("class_id"))).alias("b")).where("a is not null and b is not null").select("a", "b")

    prints = sides.mapInPandas(_fingerprints, "class_id bigint, key string, side boolean, code array<bigint>, blocks array<bigint>")
    cells = cut(prints.select("class_id", "side", "code", F.posexplode("blocks").alias("at", "block"), "key").select("class_id", "side", "code", F.xxhash64("key", "at", "block").alias("cell"), F.xxhash64("key").alias("key")))
    left = cells.where("side").select("cell", "key", F.col("class_id").alias("a"), F.col("code").alias("code_a"))
    right = cells.where("not side").select("cell", "key", F.col("class_id").alias("b"), F.col("code").alias("code_b"))
    distance = sum((F.bit_count(F.col("code_a")[i].bitwiseXOR(F.col("code_b")[i])) for i in range(BITS // 64)), F.lit(0))
    candidates = left.join(right, ["cell", "key"]).where(distance <= RADIUS).select("a", "b").distinct()
    text = lambda x: sides.select(F.col("class_id").alias(x), "key", F.col("words").alias(f"words_{x}"), F.col("text_key").alias(f"t_{x}"))
    near = candidates.join(text("a"), "a").join(text("b").withColumnRenamed("key", "key_b"), "b").where("key = key_b and t_a <> t_b").where(_near("words_a", "words_b")).select("a", "b")
    members = rows.join(sides.select("key", "text_key", F.col("side").alias("_s"), "class_id"), ["key", "text_key"]).where(F.col("_s") == is_train)
    return same.unionByName(near), members.select("class_id", "item_id", "split", "source")


def overlap_pairs(df: DataFrame) -> DataFrame:
    """(item_id_a, item_id_b), the smaller id first: every training row and row of another split that belong together.

    This expands the links of classes to their rows, as the pairs are what is asked for. Rows with equal texts are in
    pairs too. Repeated rows give no repeated pairs; an empty table gives none.
    """
    links, members = linked_classes(df)
    train, other = members.select(F.col("class_id").alias("a"), F.col("item_id").alias("x")), members.select(F.col("class_id").alias("b"), F.col("item_id").alias("y"))
    return links.join(train, "a").join(other, "b").select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b"))


def overlap_classes(df: DataFrame) -> DataFrame:
    """(item_id, split, class_id, n_links): each row in an overlap, the class of its text, and with how many classes of the other side that one is linked."""
    links, members = linked_classes(df)
    links = cut(links)
    ends = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id").select("item_id", "split", "class_id", "n_links")


def overlap_counts(df: DataFrame) -> DataFrame:
    """(split, source, n_pairs, n_items): pairs and leaked rows by the evaluation row's split and source (null as '').

    Counted from classes: an evaluation row is in as many pairs as the classes linked with its own have rows.
    """
    links, members = linked_classes(df)
    members = cut(members)
    train = members.where(F.col("split") == TRAIN).groupBy(F.col("class_id").alias("a")).agg(F.count("*").alias("n"))
    per = links.join(train, "a").groupBy(F.col("b").alias("class_id")).agg(F.sum("n").alias("n"))
    other = members.where(F.col("split") != TRAIN).groupBy("class_id", "split", F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("m"))
    return other.join(per, "class_id").groupBy("split", "source").agg(F.sum(F.col("n") * F.col("m")).alias("n_pairs"), F.sum("m").alias("n_items"))
