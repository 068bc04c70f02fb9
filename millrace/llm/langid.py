"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts, of variable order up to ``ORDER``, learned from a bounded
sample of labelled documents and frozen. A context predicts the bytes it has seen by their counts and
keeps, by method C, as many shares as it has distinct successors for an escape to the next shorter
context, from which the bytes already seen are excluded. So every context has a proper distribution
over bytes, and the code length of a text in a language is exact. The language with the shortest code
wins; the score is its posterior probability when all languages are equally likely beforehand.

All trees hang in one union tree, so a text is walked once: at each byte numpy descends from the
root along the preceding bytes, for all positions together, and each language maps the node to its own
longest known context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import doc_mod, lean, prepare, slices, utf8

ORDER = 4
#: Occurrences that a context needs to enter the tree.
LEAST = 3
#: Bounds of the training sample, for each language: documents, and bytes of their whole texts together.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 400_000
UNDETERMINED = "und"
_PIECE = 1 << 19
_NEWLINE = 10


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with the capital letters of ASCII and of the first two-byte block made small."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out


class Model:
    """Frozen context trees of several languages. ``texts``: the training bytes of each."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs = sorted(texts)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        if not self.langs:
            return
        folded = [fold(np.frombuffer(texts[k], np.uint8)) for k in self.langs]
        known = np.unique(np.concatenate([*folded, np.array([_NEWLINE], np.uint8)]))
        self.symbol = np.full(256, len(known), np.uint8 if len(known) < 256 else np.int16)
        self.symbol[known] = np.arange(len(known))
        self.width = size = len(known) + 1
        unknown = max(1, 256 - len(known))  # bytes that share the last symbol
        lead = np.full(ORDER, self.symbol[_NEWLINE], self.symbol.dtype)
        rows = [np.concatenate([lead, self.symbol[x]]) for x in folded]

        # the union tree, level by level, one language at a time; node 0 is the root
        parent, children = [np.array([-1])], []
        at = [np.arange(ORDER, len(x), dtype=np.int32) for x in rows]
        node = [np.zeros(len(x), np.int32) for x in at]

        def successors():
            return [np.unique(u.astype(np.int64) * size + x[i], return_counts=True) for u, i, x in zip(node, at, rows, strict=True)]

        levels = [(np.zeros(1, np.int64), successors())]  # nodes; of each language the next symbols with their counts
        count = 1
        for depth in range(1, ORDER + 1):
            seen = [np.unique(u.astype(np.int64) * size + x[i - depth], return_counts=True) for u, i, x in zip(node, at, rows, strict=True)]
            uniq, inv = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
            kept = np.bincount(inv, np.concatenate([n for _, n in seen]), len(uniq)) >= LEAST
            number = np.full(len(uniq), -1, np.int32)
            number[kept] = count + np.arange(int(kept.sum()))
            parent.append(uniq[kept] // size)
            children.append((uniq[kept], number[kept]))
            count += int(kept.sum())
            for k, x in enumerate(rows):
                to = number[np.searchsorted(uniq, node[k].astype(np.int64) * size + x[at[k] - depth])]
                node[k], at[k] = to[to >= 0], at[k][to >= 0]
            levels.append((number[kept], successors()))
        parents = np.concatenate(parent)
        child = np.zeros(count * size, np.int32)  # 0: no such child
        for key, number in children:
            child[key] = number
        self.child = child

        for k in range(len(self.langs)):
            known_nodes, costs = [0], []
            own = np.zeros(count, np.int32)  # union node -> this language's node
            spread = np.full(size, 1.0)
            spread[-1] = unknown
            prob = {-1: spread / spread.sum()}
            for level_nodes, follow in levels:
                pair, n = follow[k]
                nodes, first = np.unique(pair // size, return_index=True)
                edge = [*first.tolist(), len(pair)]
                for j, u in enumerate(nodes.tolist()):
                    c = n[edge[j] : edge[j + 1]]
                    s = pair[edge[j] : edge[j + 1]] % size
                    total, distinct = int(c.sum()), len(c)
                    if u and total < LEAST:
                        continue
                    above = prob[-1] if not u else prob[own[parents[u]]]
                    left = 1.0 - above[s].sum()
                    if left < 1e-9:  # all symbols seen: nothing to escape to
                        p = np.full(size, 1e-12)
                        p[s] += c / total
                    else:
                        p = above * (distinct / (total + distinct) / left)
                        p[s] = c / (total + distinct)
                    if u:
                        own[u] = len(known_nodes)
                        known_nodes.append(u)
                    prob[int(own[u])] = p
                    costs.append(p)
                # nodes of this level that the language lacks fall back to their parents
                lacking = level_nodes[(own[level_nodes] == 0) & (level_nodes > 0)]
                own[lacking] = own[parents[lacking]]
            if not costs:
                costs = [prob[-1]]
            cost = -np.log2(np.maximum(np.stack(costs), 1e-12))
            cost[:, -1] += np.log2(unknown)
            self.tables.append((own, cost.astype(np.float32).ravel()))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths (texts x languages) of adjacent texts."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for a, b in slices(offsets, _PIECE):
            for x in range(int(offsets[a]), max(int(offsets[b]), int(offsets[a]) + 1), _PIECE) if b - a == 1 else (int(offsets[a]),):
                y = min(x + _PIECE, int(offsets[b])) if b - a == 1 else int(offsets[b])
                if y <= x:
                    continue
                bounds = np.array([x, y]) if b - a == 1 else offsets[a : b + 1]
                # each text follows ORDER newlines, or the bytes before it if this is a later piece
                n = np.diff(bounds)
                to = np.concatenate([[0], np.cumsum(n + ORDER)])
                text = np.full(to[-1], self.symbol[_NEWLINE], np.int64)
                fill = np.ones(to[-1], bool)
                fill[(to[:-1, None] + np.arange(ORDER)).ravel()] = False
                text[fill] = self.symbol[fold(data[x:y])]
                if b - a == 1 and x > offsets[a]:
                    text[:ORDER] = self.symbol[fold(data[x - ORDER : x])]
                node = np.zeros(len(text) - ORDER, np.int64)
                alive = None
                for depth in range(1, ORDER + 1):
                    back = text[ORDER - depth : len(text) - depth]
                    if alive is None:
                        node = self.child[back].astype(np.int64)
                        alive = np.flatnonzero(node)
                    else:
                        deeper = self.child[node[alive] * self.width + back[alive]]
                        found = deeper > 0
                        alive = alive[found]
                        node[alive] = deeper[found]
                now = text[ORDER:]
                begin, end = to[:-1], to[:-1] + n
                for k, (own, cost) in enumerate(self.tables):
                    run = np.zeros(len(now) + 1)
                    np.cumsum(cost[own[node].astype(np.int64) * self.width + now], out=run[1:])
                    out[a:b, k] += run[end] - run[begin]
        return out


def predict(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the shortest code of each row and its posterior; the first of equal codes wins."""
    best = bits.argmin(axis=1)
    p = np.exp2(-np.clip(bits - bits.min(axis=1, keepdims=True), 0, 1000))
    return best, 1.0 / p.sum(axis=1)


def _label(shared, extra: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            data, off, _ = utf8(batch.column("text"))
            letters = np.asarray(batch.column("letters").fill_null(False)) & bool(model.langs)
            if model.langs:
                best, score = predict(model.bits(data, off))
            else:
                best, score = np.zeros(len(letters), int), np.zeros(len(letters))
            lang = [model.langs[i] if ok else UNDETERMINED for i, ok in zip(best, letters, strict=True)]
            cols = [batch.column(c) for c in extra]
            yield pa.record_batch([*cols, pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], names=[*extra, "lang_pred", "score"])

    return lean(run)


def train(spark: SparkSession, labelled: DataFrame) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``: of each language whole documents, in the order of a hash of doc_id.

    They are taken while there are at most ``SAMPLE_DOCS`` with at most ``SAMPLE_BYTES`` together; documents
    beyond that size by themselves are passed over. Rows that repeat a doc_id stand in the order of their texts, so
    a rerun takes the same ones. The driver holds the sample, whose size these bounds and the number of languages limit.
    """
    size = F.octet_length("text").cast("long")
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null").where(size <= SAMPLE_BYTES)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    order = F.xxhash64("doc_id")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.25 * SAMPLE_DOCS + 50) / n))])
    near = labelled.where((F.pmod(order, F.lit(1 << 40)) / F.lit(float(1 << 40))) <= F.element_at(share, F.col("lang")))
    along = Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 40)), "doc_id", F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, 0)
    near = near.select("lang", "text", F.sum(size + 1).over(along).alias("bytes"), F.count("*").over(along).alias("n"))
    rows = near.where((F.col("bytes") <= SAMPLE_BYTES + 1) & (F.col("n") <= SAMPLE_DOCS)).collect()
    texts: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        texts[r["lang"]].append(r["text"].encode())
    return Model({k: b"\n".join(v) for k, v in texts.items()})


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; other columns stay, equally named ones are replaced.

    Null texts and texts without any letter get ``und`` and 0.
    """
    prepare(spark)
    docs = docs.drop("lang_pred", "score")
    extra = docs.columns
    given = docs.withColumn("letters", F.col("text").rlike(r"\p{L}"))
    shared = spark.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(_label(shared, extra), schema)


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row; learns only from rows not held out.

    A row without doc_id is neither held out nor learned from. Repeated rows are each predicted, and alike. Texts of
    any length are coded whole, in pieces. Of languages with equal code lengths the first by name is taken.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(spark, docs.where(doc_mod(F.col("doc_id"), 3) != 1))
    out = identify(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(doc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
