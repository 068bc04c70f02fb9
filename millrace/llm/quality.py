"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features in turn, and each time fits a
shallow tree on that one feature to the residuals, at a low learning rate; the trees of a feature add up
to one lookup table. Then pairs of features, those whose joint table explains most of what is left,
get tables of their own in the same way. A score is a sum of looked-up values through the logistic
function, so each feature's part in it can be read off.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import cut, doc_mod, prepare, slices, utf8, word_hashes

BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
LEAVES = 4
RATE = 0.1
#: Labelled documents that training takes at most; those with the least hashes of doc_id.
SAMPLE = 20_000
THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_length", "upper", "digits", "stops", "symbols", "non_ascii", "lines", "distinct_words",
    "repeated_next", "top_word", "short_words", "word_end_symbols", "exclamations",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:"]] = 4
_CLASS[[ord(c) for c in "\"'()-"]] = 5
_CLASS[[b for b in range(0x21, 0x7F) if not _CLASS[b]]] = 6
_CLASS[128:] = 7
_CLASS[[0x20, *range(0x09, 0x0E)]] = 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each of the adjacent texts; empty texts have zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(part):
            continue
        kind = _CLASS[part]

        def per_text(mask: np.ndarray, off=off) -> np.ndarray:
            run = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=run[1:])
            return run[off[1:]] - run[off[:-1]]

        size = np.maximum(np.diff(off), 1)
        count = [per_text(kind == k) for k in range(9)]
        letters = np.maximum(count[1] + count[2], 1)
        last = np.zeros(len(part), bool)
        last[:-1] = (kind[1:] == 8) & (kind[:-1] == 6)
        hashes, first = word_hashes(part, off)
        words = np.diff(first)
        some = np.maximum(words, 1)
        same = np.zeros(len(hashes) + 1, np.int64)
        if len(hashes) > 1:
            np.cumsum(hashes[1:] == hashes[:-1], out=same[2:])
        inner = np.maximum(first[1:], 1)
        repeated = np.where(words > 0, same[inner] - same[np.minimum(first[:-1] + 1, len(hashes))], 0)
        distinct, top = np.zeros(b - a), np.zeros(b - a)
        for i in np.flatnonzero(words).tolist():
            own = np.sort(hashes[first[i] : first[i + 1]])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[i], top[i] = len(edge) - 1, np.diff(edge).max()
        single = np.zeros(len(part), bool)
        single[1:-1] = (kind[1:-1] != 8) & (kind[:-2] == 8) & (kind[2:] == 8)
        out[a:b] = np.stack(
            [
                np.log1p(words), (size - count[8]) / some, count[1] / letters, count[3] / size, count[4] / some, (count[5] + count[6]) / some,
                count[7] / size, per_text(part == 10) / some, np.log1p(distinct) / np.log1p(some), repeated / some, top / some,
                per_text(single) / some, per_text(last) / some, per_text(part == 33) / some,
            ],
            axis=1,
        )
        out[a:b][words == 0] = 0
    return out


def _best_tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values by bin of a tree on one binned feature, grown by best gain; ``grad``, ``hess``: sums by bin."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                x = np.arange(a + 1, b)
                gain = value(a, x) + value(x, b) - value(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], k, int(x[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _best_quadrants(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Values by cell of the best tree of depth two on two features: one cut of each makes four leaves."""
    g, h = (np.pad(v.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for v in (grad, hess))

    def leaf(v: np.ndarray) -> list[np.ndarray]:
        low, left, all_ = v[:, -1:], v[-1:, :], v[-1, -1]
        return [v, low - v, left - v, all_ - low - left + v]

    parts = list(zip(leaf(g), leaf(h), strict=True))
    gain = sum(a**2 / (b + 5.0) for a, b in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(grad.shape)
    for (a, b), rows, cols in zip(parts, (slice(0, i), slice(0, i), slice(i, None), slice(i, None)), (slice(0, j), slice(j, None)) * 2, strict=True):
        out[rows, cols] = a[i, j] / (b[i, j] + 5.0)
    return out


class Model:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        d = len(FEATURES)
        self.base, self.edges, self.coarse, self.tables, self.pairs = 0.0, [np.zeros(0)] * d, [np.zeros(0)] * d, [np.zeros(1)] * d, {}
        if not len(y):
            return
        p0 = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p0 / (1 - p0)))
        if y.min() == y.max():
            return
        cuts = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(d)]
        self.edges, self.coarse = cuts(BINS), cuts(PAIR_BINS)
        bins = [np.searchsorted(self.edges[j], x[:, j], "right") for j in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j in range(d):
                p = 1 / (1 + np.exp(-score))
                m = len(self.tables[j])
                step = RATE * _best_tree(np.bincount(bins[j], y - p, m), np.bincount(bins[j], p * (1 - p), m), LEAVES)
                self.tables[j] += step
                score += step[bins[j]]
        rough = [np.searchsorted(self.coarse[j], x[:, j], "right") for j in range(d)]
        width = [len(e) + 1 for e in self.coarse]
        p = 1 / (1 + np.exp(-score))
        gain = {}
        for i in range(d):
            for j in range(i):
                cell, m = rough[i] * width[j] + rough[j], width[i] * width[j]
                g, h = np.bincount(cell, y - p, m), np.bincount(cell, p * (1 - p), m)
                gain[i, j] = (g**2 / (h + 5.0)).sum()
        chosen = sorted(gain, key=gain.get, reverse=True)[:PAIRS]
        self.pairs = {k: np.zeros((width[k[0]], width[k[1]])) for k in chosen}
        for _ in range(PAIR_ROUNDS):
            for (i, j), t in self.pairs.items():
                p = 1 / (1 + np.exp(-score))
                cell, m = rough[i] * width[j] + rough[j], t.size
                g = np.bincount(cell, y - p, m).reshape(t.shape)
                h = np.bincount(cell, p * (1 - p), m).reshape(t.shape)
                step = RATE * _best_quadrants(g, h)
                t += step
                score += step[rough[i], rough[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (i, j), t in self.pairs.items():
            total += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _featurise(keep: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, off, _ = utf8(batch.column("text"))
            rows = features(data, off)
            flat = pa.array(rows.ravel(), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, rows.shape[1], dtype=np.int32)), flat)
            yield pa.record_batch([*(batch.column(c) for c in keep), lists], names=[*keep, "features"])

    return run


def _apply(shared, keep: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = pickle.loads(shared.value)
        for batch in batches:
            x = np.asarray(batch.column("features").flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(model.score(x))], names=[*keep, "score"])

    return run


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` without its text but with the array ``features`` of the whole text."""
    keep = [c for c in docs.columns if c not in ("text", "features")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.FloatType()))])
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_featurise(keep), schema)


def train(known: DataFrame) -> Model:
    """Fit on ``known(doc_id, features, quality)``: the ``SAMPLE`` rows with the least hashes of doc_id.

    A bound on the hash, from the number of rows, leaves little more than the sample before rows are
    ordered, so tasks do not send a sample each.
    """
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    known = cut(known)
    share = min(1.0, (1.25 * SAMPLE + 200) / max(1, known.count()))
    near = known.where(order <= int(share * (1 << 40)))
    rows = near.orderBy(order, "doc_id", "quality").limit(SAMPLE).select("features", "quality").collect()
    x = np.array([r["features"] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    return Model(x.astype(np.float64), np.array([float(r["quality"]) for r in rows]))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learns from ``labels(doc_id, quality)`` of rows not held out, quality being 0 or 1. Labels without a
    document, null labels and documents without doc_id teach nothing; a label or a document that is repeated teaches as
    often as it stands there. Null and empty texts get the score of their (zero) features, repeated rows equal scores,
    and long texts are read whole, in pieces. With no labels at all every score is 0.5.
    """
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = doc_mod(F.col("doc_id"), 4) == 2
    rows = cut(with_features(docs))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    given = given.where(F.col("quality").isin(0, 1) & ~held)
    model = train(rows.join(given, "doc_id"))
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    out = rows.mapInArrow(_apply(shared, ["doc_id"]), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
