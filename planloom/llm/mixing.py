"""Problem 7: documents of several sources combined so that each source has its target share of all tokens.

Tokens are those of a public tokenizer. The documents of a source are laid end to end in a pseudorandom order and packed
into blocks of exactly ``BLOCK_TOKENS`` tokens (the last of a source may be shorter); a document may begin in one block
and end in a later one. The output is a number of slots, in shards of ``SHARD_SLOTS``; each shard draws how many of its
slots each source gets from one multinomial distribution. A source's slots, counted through all shards, are mapped to its
blocks by a pseudorandom permutation of their indices, one pass through all blocks after the other, and joined to them by
index; so a block, and with it a document, is used at most as often as there are passes, which ``max_repeats`` bounds. A
source that runs out of blocks can't reach its target.

The place of a document in its source is a prefix sum over two levels (within a bucket, over the buckets), and so is the
first slot of a shard, so that no task holds a source. What comes to the driver is bounded: one row per source of the
targets, of which there may be ``MOST_SOURCES``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.session import cut

#: Where the vocabulary files of public tokenizers are on the driver, which sends the one that is used to all tasks.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: How the byte-level BPE splits texts before merging (fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK_TOKENS = 128
#: Slots per shard of the output, and slots that one task maps at most, about.
SHARD_SLOTS, TASK_SLOTS = 1024, 65_536
#: Most sources in the targets.
MOST_SOURCES = 10_000
SEED = 42
#: Documents per bucket of a source's order, about.
BUCKET_DOCS = 20_000


@lru_cache(maxsize=4)
def _encoding(name: str):
    import tiktoken
    from pyspark import SparkFiles

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(SparkFiles.get(name)).read_bytes().splitlines() if x)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(name: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(name).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": np.fromiter((len(encode(t)) for t in b["text"]), np.int64, len(b))})

    return count


def source_name(c: Column) -> Column:
    """A source as the targets spell it, whatever its case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def token_counts(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents whose source has a target; null and empty texts have no tokens and are left out.

    Of targets whose names differ in case, blanks and hyphens only, the first by name gets the documents.
    """
    documents.sparkSession.sparkContext.addFile(f"{tokenizers}/{tokenizer}.tiktoken")
    wanted = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("_s")).agg(F.min("source").alias("_name"))
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text", source_name(F.col("source")).alias("_s"))
    return docs.join(wanted, "_s").select("doc_id", F.col("_name").alias("source"), "text").mapInPandas(_count_tokens(f"{tokenizer}.tiktoken"), "doc_id bigint, source string, tokens bigint")


def placed(counted: DataFrame, n_docs: int, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, start): documents with the place of their first token among those of their source."""
    buckets = max(1, n_docs // BUCKET_DOCS)
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = counted.withColumns({"_h": h, "_b": F.pmod(h, F.lit(buckets))})
    w = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumn("_end", F.sum("tokens").over(w))
    sums = rows.groupBy("source", "_b").agg(F.sum("tokens").alias("_t"))  # one row per source and bucket
    before = F.sum("_t").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    return inner.join(offsets, ["source", "_b"]).select("doc_id", "source", "tokens", (F.col("_before") + F.col("_end") - F.col("tokens")).alias("start"))


def packed(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, tokens, block, part): each document once for each block that it has tokens in; part is how many."""
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("tokens") - 1) / block_tokens)
    rows = docs.where("tokens > 0").withColumn("block", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    part = F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * block_tokens) - F.greatest("start", F.col("block") * block_tokens)
    return rows.select("doc_id", "source", "tokens", "block", part.alias("part"))


def shares(targets: dict[str, float], capacity: dict[str, float], total: float) -> dict[str, float]:
    """The probabilities with which slots are drawn: targets, but of a source that can't fill its share only what it has."""
    out, fixed = {}, set()
    while True:
        left = total - sum(capacity[s] for s in fixed)
        weight = sum(t for s, t in targets.items() if s not in fixed)
        over = {s for s, t in targets.items() if s not in fixed and weight > 0 and left * t / weight > capacity[s]}
        if not over:
            break
        fixed |= over
    for s, t in targets.items():
        out[s] = capacity[s] / total if s in fixed else (left * t / weight / total if weight > 0 else 0.0)
    return out


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The places of ``index`` in a pseudorandom permutation of range(size): four Feistel rounds, walked until inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for r in range(4):
                k = (right + np.uint64(seed * 4 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
                k = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((k >> np.uint64(29)) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo = x >= np.uint64(size)
    return x.astype(np.int64)


def _slots(plan: list[tuple[str, float]], n_slots: int, shard_slots: int, seed: int):
    """Of a shard number: the slots of each source, drawn, as (source, shard, n)."""
    names, p = [s for s, _ in plan], np.array([x for _, x in plan])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                size = min(shard_slots, n_slots - int(shard) * shard_slots)
                n = np.random.default_rng([seed, int(shard)]).multinomial(size, p / p.sum())
                yield pd.DataFrame({"source": names, "shard": int(shard), "n": n.astype(np.int64)})

    return draw


def _map_slots(blocks: dict[str, int], passes: dict[str, int], seed: int):
    """Of slots (source, first, n): the blocks that they take, one row per slot; slots beyond the last pass take none."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, first, n in zip(b["source"], b["first"], b["n"]):
                size = blocks[source]
                slots = np.arange(first, min(first + n, size * passes[source]), dtype=np.int64)
                if size and len(slots):
                    where = np.empty(len(slots), np.int64)
                    for turn in np.unique(slots // size):
                        own = slots // size == turn
                        where[own] = permuted(slots[own] % size, size, seed + 7919 * int(turn))
                    yield pd.DataFrame({"source": source, "block": where})

    return take


def _first_slots(drawn: DataFrame) -> DataFrame:
    """(source, shard, first, n): with the number of a source's slots in all earlier shards, summed in groups of shards first."""
    group = F.floor(F.col("shard") / 4096)
    inner = F.sum("n").over(Window.partitionBy("source", group).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sums = drawn.groupBy("source", group.alias("g")).agg(F.sum("n").alias("t"))
    before = sums.select("source", "g", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return drawn.withColumns({"g": group, "inner": F.coalesce(inner, F.lit(0))}).join(before, ["source", "g"]).select("source", "shard", (F.col("before") + F.col("inner")).alias("first"), "n")


def taken_blocks(spark, plan: dict[str, float], blocks: dict[str, int], passes: dict[str, int], n_slots: int, seed: int = SEED) -> DataFrame:
    """(source, block, uses): how often each block is used, by the slots that the shards draw for its source with the chances of ``plan``."""
    n_shards = -(-n_slots // SHARD_SLOTS)
    tasks = max(1, -(-n_slots // TASK_SLOTS))
    drawn = cut(spark.range(0, n_shards, 1, tasks).mapInPandas(_slots(sorted(plan.items()), n_slots, SHARD_SLOTS, seed), "source string, shard bigint, n bigint"))
    # a fixed number of parts: a few rows become many slots, so they aren't to be put together by their size
    slots = _first_slots(drawn).where("n > 0").repartition(tasks, "shard").mapInPandas(_map_slots(blocks, passes, seed), "source string, block bigint")
    return slots.groupBy("source", "block").agg(F.count("*").alias("uses"))


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED, tokenizers: str = TOKENIZERS, tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The documents of a mixture, and what became of the targets.

    documents: doc_id, source, text. targets: source (key), target_share, max_repeats; null shares count as 0, null
    repeats as 1, of repeated sources the first in order counts. total_tokens: size of the mixture; by default the
    tokens of all documents that have a target.

    First (doc_id, source, tokens, uses, used_tokens), documents of which any block is used: uses, at most max_repeats,
    is how often the one of its blocks that is used most, used_tokens how many of its tokens all uses of its blocks are.
    Second, per source of the targets, (source, tokenizer, target_share, drawn_share, available_tokens, used_tokens,
    actual_share, documents, reached): drawn_share is the chance of a slot to be the source's, which is above the target
    where others can't fill theirs; reached is whether its documents, used max_repeats times, hold its share of the
    total. Documents without a target source are left out. No documents or no targets: no uses, shares of 0.
    """
    spark = documents.sparkSession
    named = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(-F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(1)))).alias("g"))
    goals = sorted((r.source, -float(r.g[0]), int(r.g[1])) for r in named.limit(MOST_SOURCES + 1).collect())
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    counted = cut(token_counts(documents, targets, tokenizers, tokenizer))
    docs = cut(placed(counted, counted.count(), seed))
    have = {r.source: r for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # one row per source of the targets
    available = {s: int(have[s].tokens if s in have else 0) for s, _, _ in goals}
    blocks = {s: -(-n // block_tokens) for s, n in available.items()}
    passes = {s: n for s, _, n in goals}
    total = total_tokens if total_tokens is not None else sum(available.values())
    weight = {s: t for s, t, _ in goals if t > 0}
    plan = shares(weight, {s: float(available[s] * passes[s]) for s in weight}, float(total)) if total else {}
    if plan and sum(plan.values()) > 0:
        taken = taken_blocks(spark, plan, blocks, passes, -(-total // block_tokens), seed)
    else:
        plan = {}
        taken = spark.createDataFrame([], "source string, block bigint, uses bigint")
    # both sides grow with the data
    by_block = packed(docs, block_tokens).join(taken.hint("merge"), ["source", "block"])
    used = cut(by_block.groupBy("doc_id", "source", "tokens").agg(F.max("uses").alias("uses"), F.sum(F.col("part") * F.col("uses")).alias("used_tokens")))

    sums = used.groupBy("source").agg(F.sum("used_tokens").alias("used"), F.count("*").alias("documents"))
    whole = F.sum("used").over(Window.partitionBy(F.lit(0)))  # one row per source
    base = spark.createDataFrame(
        [(s, tokenizer, t, plan.get(s, 0.0), available[s], bool(t > 0 and available[s] * passes[s] >= t * total and available[s] > 0)) for s, t, _ in goals],
        "source string, tokenizer string, target_share double, drawn_share double, available_tokens bigint, reached boolean",
    )
    report = base.join(sums, "source", "left").select(
        "source", "tokenizer", "target_share", "drawn_share", "available_tokens",
        F.coalesce("used", F.lit(0)).cast("bigint").alias("used_tokens"),
        F.coalesce(F.col("used") / whole, F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
        "reached",
    )
    return used, report
