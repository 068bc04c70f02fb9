"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source are packed into blocks of one length, document after document: ``BLOCK`` words, fewer for
small sources, so that a block is at most a ``FINE``-th of its source or one word. The mix is a
row of slots, each taking one block, dealt over output shards. The slots of a shard fall to the sources
by multinomial draws, conditioned on every source's total over all shards being its quota: totals are
split in halves of the shards again and again, each split being a multivariate hypergeometric draw seeded by
its place, so any shard can be drawn by itself and reruns agree. Slot j of a source maps through the source's
pseudorandom permutation for the pass ``j // blocks`` to a block index, and blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import WORD, cut, mix, prepare

#: Words in a block at most, and blocks that a source has at least, if it has as many words.
BLOCK, FINE = 64, 256
SHARD_SLOTS = 4096
WEIGHTS = (5, 2, 1)
#: Times that a source's words are taken at most.
MOST = 3
#: Documents in a stretch, the unit in which positions within a source are summed up.
STRETCH = 512
#: Items from which on a split is not drawn by numpy's sampler, whose range ends there.
LARGE = 10**9
SEED = 20240517
_U = np.uint64


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    block: int
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; what exceeds is shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free.difference_update(over)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def _plan(totals: list[tuple[str | None, int]], weights: tuple[float, ...]) -> list[Source]:
    totals = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    target = targets([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))])
    out = []
    for (name, size), t in zip(totals, target, strict=True):
        block = min(BLOCK, max(1, size // FINE))
        blocks = -(-size // block)
        out.append(Source(name, size, t, block, blocks, min(MOST * blocks, round(t * blocks / size)) if size else 0))
    return out


def _split(counts: np.ndarray, left: int, seed: tuple[int, ...]) -> np.ndarray:
    """Of ``counts`` items of each kind, how many of each fall among the first ``left`` places."""
    total = int(counts.sum())
    if left >= total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    if total < LARGE:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    # beyond the sampler's range: every item falls among the first places by itself, with the right mean; what is too
    # many or too few then, some square root of the total, is taken back or added evenly. That is the same law, exactly.
    out = rng.binomial(counts, left / total)
    more = left - int(out.sum())
    pool = counts - out if more > 0 else out
    ends = np.cumsum(pool)
    drawn = rng.choice(int(ends[-1]), abs(more), replace=False, shuffle=False)
    moved = np.bincount(np.searchsorted(ends, drawn, "right"), minlength=len(counts))
    return out + moved if more > 0 else out - moved


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """How many slots of each source the shards before this one have, and how many this one has."""
    before, counts, lo, hi = np.zeros_like(slots), slots.copy(), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(counts, min(int(counts.sum()), (mid - lo) * SHARD_SLOTS), (seed, lo, hi))
        if shard < mid:
            counts, hi = left, mid
        else:
            before, counts, lo = before + left, counts - left, mid
    return before, counts


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of ``x`` under a pseudorandom permutation of range(n): a Feistel network, walked until within range."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = _U((1 << half) - 1)
    y = x.astype(_U)
    todo = np.ones(len(y), bool)
    while todo.any():
        left, right = y[todo] >> _U(half), y[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + _U((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) & mask)
        y[todo] = left << _U(half) | right
        todo = y >= _U(n)
    return y.astype(np.int64)


def _deal(plan, shards: int, seed: int):
    """``plan``: a broadcast array with the slots and the blocks of each source."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        quota, blocks = plan.value
        for frame in frames:
            for shard in frame["id"].tolist():
                before, counts = shard_counts(quota, shards, shard, seed)
                parts = []
                for s in np.flatnonzero(counts).tolist():
                    j = np.arange(before[s], before[s] + counts[s])
                    turn, place = np.divmod(j, int(blocks[s]))
                    block = np.empty(len(j), np.int64)
                    for t in np.unique(turn).tolist():
                        own = turn == t
                        block[own] = permute(place[own], int(blocks[s]), int(mix(np.array([seed * 1_000_003 + s * 17 + t], _U))[0]))
                    parts.append(pd.DataFrame({"source_no": s, "block": block}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    order = np.random.default_rng((seed, shard, 1)).permutation(len(out))
                    out = out.iloc[order]
                    out.insert(0, "slot", np.arange(len(out)))
                    out.insert(0, "shard", shard)
                    yield out

    return run


@dataclass
class Mix:
    """A plan for a mix: ``slots(shard, slot, source_no, block)`` and ``extents``, where each document lies."""

    sources: list[Source]
    slots: DataFrame
    extents: DataFrame


def plan_mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> Mix:
    """Plan a mix of ``docs(doc_id, text, source)`` whose sources, by code point, null last, weigh ``weights`` in turn.

    The driver holds one total for each source, and its plan goes to the workers as a broadcast of 16 bytes a source: a source
    is something like a crawl or a collection, and hundreds of thousands of them are meant, not one for each document. Within a source documents lie in the order of a hash of
    doc_id, so that positions can be summed up by stretches of about ``STRETCH`` documents: a
    source with a third of all rows has as many stretches as a third of the rows needs.
    """
    prepare(spark)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    base = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    totals = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sources = _plan([(r["source"], r["size"]) for r in totals], weights)
    stretches = {r["source"]: r["n"] // STRETCH + 1 for r in totals}

    table = spark.createDataFrame(
        [(s.name, i, s.size, s.target, s.block, stretches[s.name]) for i, s in enumerate(sources)], "name string, source_no int, source_size long, target double, block_size int, stretches long"
    )
    numbered = base.join(F.broadcast(table) if len(sources) <= 100_000 else table, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    numbered = numbered.withColumn("stretch", F.pmod(F.xxhash64("doc_id"), F.col("stretches")))
    order = Window.partitionBy("source_no", "stretch").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sums = numbered.groupBy("source_no", "stretch").agg(F.sum("size").alias("all"))
    along = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("source_no", "stretch", (F.sum("all").over(along) - F.col("all")).alias("offset"))
    extents = (
        numbered.withColumn("within", F.sum("size").over(order) - F.col("size"))
        .join(sums, ["source_no", "stretch"])
        .select("doc_id", "source", "source_no", "size", "source_size", "target", "block_size", (F.col("offset") + F.col("within")).alias("start"))
    )
    total = sum(s.slots for s in sources)
    shards = -(-total // SHARD_SLOTS)
    deal = _deal(spark.sparkContext.broadcast(np.array([[s.slots for s in sources], [s.blocks for s in sources]], np.int64)), shards, seed)
    ids = spark.range(0, max(shards, 1), 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4)))
    slots = (ids if shards else ids.limit(0)).mapInPandas(deal, "shard long, slot long, source_no int, block long")
    return Mix(sources, slots, extents)


def taken_words(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` counts the words of the document in the mix, repeats included; no block is taken more than
    ``MOST`` times. Null and empty texts have size 0 and are not taken. Rows repeating a doc_id lie apart, and repeated rows
    one after the other. A text of any length is counted whole, and spreads over as many blocks as it needs.
    """
    mixed = plan_mix(spark, docs, weights, seed)
    extents = cut(mixed.extents)
    counts = mixed.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    last = F.col("start") + F.col("size") - 1
    pieces = extents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr("start div block_size"), F.expr("(start + size - 1) div block_size"))))
    words = F.least(last + 1, (F.col("block") + 1) * F.col("block_size")) - F.greatest("start", F.col("block") * F.col("block_size"))
    row = ["doc_id", "source_no", "start", "size", "source_size", "target"]
    # the planner knows nothing of how many rows the deal makes, so it must not broadcast them
    taken = pieces.withColumn("words", words).join(counts.hint("merge"), ["source_no", "block"], "left")
    taken = taken.groupBy(*row).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*cols).union(extents.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))


def mix_documents(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` in the proportions of the mix: each row as often as the mix takes its words, by its size.

    A document of which the mix takes ``taken`` of ``size`` words appears ``taken / size`` times, rounded up
    or down by a hash of its doc_id so that the expected number of words is ``taken``. Documents without words
    stay as they are; rows that repeat a doc_id share what is taken of them together.
    """
    taken = taken_words(spark, docs, weights, seed).groupBy("doc_id").agg(F.sum("size").alias("__size"), F.sum("taken").alias("__taken"))
    luck = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    copies = F.when(F.col("__size") == 0, 1).otherwise(F.floor(F.col("__taken") / F.col("__size") + luck)).cast("int")
    joined = docs.join(taken.withColumnRenamed("doc_id", "__id"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    return joined.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*docs.columns)
