"""Exact top-k search by inner product, by best-first search of M-trees.

Inner products become distances by one more coordinate: with R no less than any vector's norm, v goes to
(v, sqrt(R^2 - |v|^2)) and a query to (q, 0); then d^2 = |q|^2 + R^2 - 2 q.v, so the largest
inner products are the nearest vectors in a metric space.

The vectors are dealt over shards by clusters, whose centres are fitted on a bounded sample, and within
large clusters by a hash; each shard is an M-tree: pages of at most
``PAGE`` entries, each with a routing vector, a covering radius and the distances of its entries to its
routing vector. A query visits pages in the order of their least possible distance and ends when that
exceeds the distance of its k-th best. Where the triangle inequality on stored distances already rules an
entry out, its distance is not computed. Scores themselves are exact integers, of any size.

Queries go in blocks. Groups of blocks and runs of shards meet in partitions, sorted so that the blocks come first: a
worker holds one group's queries with their best so far, and the trees of the run stream past, so that what one
shard gives bounds the search in the next ones, and whole shards are left out by their roots.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut, prepare

PAGE = 256
SHARD = 8192
BLOCK = 64
#: Blocks that one copy of a tree serves, and shards in a run at most.
GROUP, RUN = 128, 32
#: Vectors, and components together, of the sample that centres are fitted on; centres at most.
SAMPLE, SAMPLE_CELLS, CENTRES = 4096, 1 << 21, 256
SCALE = 256
EVERY = 50
K = 5
#: Up to this, products of up to 512 components are exact as doubles; vectors beyond are scaled down to it for the tree, and their scores computed as Python integers.
SAFE = 1 << 22


@dataclass
class Page:
    """A page of the tree; ``entries`` are children's page numbers or, in a leaf, vector numbers."""

    leaf: bool
    routing: int
    radius: float
    entries: np.ndarray
    #: Distances of the entries (children's routing vectors) to this page's routing vector.
    distances: np.ndarray
    #: Covering radii of the children; empty in a leaf.
    radii: np.ndarray
    #: The children's routing vectors; empty in a leaf.
    centres: np.ndarray


class Tree:
    """An M-tree over integer vectors, bulk-loaded from the top by seeded splits."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.pages: list[Page] = []
        #: Entries whose distance to a query was computed.
        self.computed = 0
        if not len(ids):
            return
        self.unit = unit(self.vectors)
        v = self.vectors.astype(np.float64) / self.unit
        square = (v**2).sum(axis=1)
        self.reach = float(square.max())
        self.points = np.column_stack([v, np.sqrt(np.maximum(self.reach - square, 0))])
        self.root = self._build(np.arange(len(ids)), np.random.default_rng(len(ids)))

    def _to(self, point: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        centre = self.points[rows].mean(axis=0)
        routing = int(rows[self._to(centre, rows).argmin()])
        reach = self._to(self.points[routing], rows)
        if len(rows) <= PAGE:
            self.pages.append(Page(True, routing, float(reach.max()), rows, reach, np.zeros(0), np.zeros((0, 0))))
            return len(self.pages) - 1
        many = min(PAGE, -(-len(rows) * 3 // (PAGE * 2)))
        seeds = rng.choice(rows, many, replace=False)
        for _ in range(2):
            nearest = self._far(rows, seeds).argmin(axis=1)
            seeds = np.array([rows[nearest == k][self._to(self.points[rows[nearest == k]].mean(axis=0), rows[nearest == k]).argmin()] for k in np.unique(nearest)])
        nearest = self._far(rows, seeds).argmin(axis=1)
        parts = [rows[nearest == k] for k in np.unique(nearest)]
        if len(parts) == 1:  # equal vectors: any split will do
            parts = np.array_split(rows, -(-len(rows) // PAGE))
        children = np.array([self._build(p, rng) for p in parts])
        own = self.points[[self.pages[c].routing for c in children]]
        radii = np.array([self.pages[c].radius for c in children])
        apart = np.sqrt(((own - self.points[routing]) ** 2).sum(axis=1))
        self.pages.append(Page(False, routing, float(reach.max()), children, apart, radii, own))
        return len(self.pages) - 1

    def _far(self, rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        a, b = self.points[rows], self.points[seeds]
        return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T

    def search(self, own: int, query: np.ndarray, k: int, best: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), best first, equal scores by id, without vectors of id ``own``; ``best`` has those of other trees."""
        best = list(best or [])
        if not self.pages:
            return best
        own_unit = unit(query[None])
        exact = self.unit == own_unit == 1.0
        scale = self.unit * own_unit
        point = np.append(query.astype(np.float64) / own_unit, 0.0)
        base = float((point**2).sum()) + self.reach
        # what rounding may hide, in distances and in scaled scores
        slack, doubt = 1e-7 * (1.0 + base**0.5), 0.0 if exact else 1e-9 * (1.0 + base)

        def bound() -> float:
            return max(0.0, base - 2.0 * (best[-1][0] / scale)) ** 0.5 if len(best) == k else np.inf

        limit = bound()
        root = self.pages[self.root]
        apart = float(np.sqrt(((self.points[root.routing] - point) ** 2).sum()))
        heap = [(max(0.0, apart - root.radius), self.root, apart)]
        while heap:
            low, number, apart = heapq.heappop(heap)
            if low > limit + slack:
                break
            page = self.pages[number]
            if page.leaf:
                near = page.entries[np.abs(apart - page.distances) <= limit + slack]
                near = near[self.ids[near] != own]
                self.computed += len(near)
                s = self.points[near, :-1] @ point[:-1]
                if len(best) == k:  # ties with the k-th stay in
                    high = s >= best[-1][0] / scale - max(doubt, 0.25)
                    near, s = near[high], s[high]
                if len(near) > 4 * k:
                    high = s >= np.partition(s, len(s) - k)[len(s) - k] - 2 * doubt
                    near, s = near[high], s[high]
                if len(near):
                    scores = np.rint(s).astype(np.int64).tolist() if exact else [sum(map(int.__mul__, v, query.tolist())) for v in self.vectors[near].tolist()]
                    best = sorted([*best, *zip(scores, self.ids[near].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                    limit = bound()
            else:
                open_ = np.abs(apart - page.distances) - page.radii <= limit + slack
                children = page.entries[open_]
                d = np.sqrt(((page.centres[open_] - point) ** 2).sum(axis=1))
                for c, x, low in zip(children.tolist(), d.tolist(), np.maximum(0, d - page.radii[open_]).tolist(), strict=True):
                    if low <= limit + slack:
                        heapq.heappush(heap, (low, c, x))
        return best


def unit(vectors: np.ndarray) -> float:
    """What to divide vectors by, so that sums of their products are exact as doubles, or at least close: 1 if they are small enough."""
    most = max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0
    least = SAFE * (512 / max(512, vectors.shape[1])) ** 0.5
    return 1.0 if most <= least else most / least


def centres_of(vectors: np.ndarray, many: int) -> np.ndarray:
    """Centres of so many clusters, by a few rounds of k-means with seeded starts."""
    v = vectors.astype(np.float64)
    centres = v[np.random.default_rng(len(v)).choice(len(v), min(many, len(v)), replace=False)]
    for _ in range(6):
        near = nearest(v, centres)
        centres = np.stack([v[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * v @ centres.T).argmin(axis=1)


def _cluster(shared):
    """The number of the nearest centre; 0 for dimensions without centres."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out, dims = np.zeros(batch.num_rows, np.int64), np.asarray(batch.column("dim"))
            lists = batch.column("v")
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            for d in np.unique(dims).tolist():
                if d in shared.value:
                    rows = np.flatnonzero(dims == d)
                    out[rows] = nearest(flat[ends[rows][:, None] + np.arange(d)].astype(np.float64), shared.value[d])
            yield pa.record_batch([*(batch.column(c) for c in ("vec_id", "v", "dim")), pa.array(out)], names=["vec_id", "v", "dim", "cluster"])

    return run


def _plant(pdf):
    import pandas as pd

    tree = Tree(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.int64).reshape(len(pdf), -1))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "body": [pickle.dumps(tree, 5)]})


def _bundle(pdf):
    import pandas as pd

    body = pickle.dumps((pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.int64).reshape(len(pdf), -1)), 5)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "body": [body]})


def _search(k: int):
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held = None, []

        def out():
            rows = [(block, n, int(q), clip(s), i) for block, ids, _, best in held for n, q in enumerate(ids) for s, i in best[n]]
            held.clear()
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["block", "n", "query_id", "score", "vec_id"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("dim", "run", "group", "is_tree", "block")]
            for *now, is_tree, block, body in zip(*cols, batch.column("body"), strict=True):
                if now != key:
                    yield from out()
                    key = now
                if not is_tree:
                    ids, vectors = pickle.loads(body.as_buffer())
                    held.append((block, ids, vectors, [[] for _ in ids]))
                    continue
                tree = pickle.loads(body.as_buffer())
                for _, ids, vectors, best in held:
                    for n, (q, v) in enumerate(zip(ids, vectors, strict=True)):
                        best[n] = tree.search(int(q), v, k, best[n])
        yield from out()

    return run


def _clustered(spark: SparkSession, given: DataFrame, counts: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """``given(vec_id, v, dim)`` with ``shard``, and the number of shards by dimension: vectors near one another, at most some ``SHARD`` of them, together.

    Centres are fitted on a sample: of each dimension with more than one shard the vectors with the least hashes, whose
    number the driver bounds. Every vector is dealt to its nearest centre, so the sample says how well shards are
    separated, and nothing about the results.
    """
    large = {d: min(SAMPLE, max(16, SAMPLE_CELLS // max(1, d))) for d, n in counts.items() if n > SHARD and d}
    centres = {}
    if large:
        share = F.create_map(*[F.lit(x) for d, m in large.items() for x in (d, min(1.0, 1.25 * m / counts[d]))])
        place = F.pmod(F.xxhash64(F.lit(2), "vec_id", "v"), F.lit(1 << 40))
        near = given.where(place / F.lit(float(1 << 40)) <= F.try_element_at(share, F.col("dim")))
        taken: dict[int, list] = {}
        for r in near.select("dim", place.alias("h"), "vec_id", "v").collect():
            taken.setdefault(r["dim"], []).append((r["h"], r["vec_id"], r["v"]))
        for d, rows in taken.items():
            centres[d] = centres_of(np.array([v for *_, v in sorted(rows)[: large[d]]], np.float64), min(CENTRES, -(-counts[d] // SHARD)))
    shared = spark.sparkContext.broadcast(centres)
    near = cut(given.mapInArrow(_cluster(shared), "vec_id long, v array<bigint>, dim int, cluster long"))
    # one row a centre at most
    sizes = sorted((r["dim"], r["cluster"], r["n"]) for r in near.groupBy("dim", "cluster").agg(F.count("*").alias("n")).collect())
    first, number = {}, {}
    for d, c, n in sizes:
        first[d, c] = number.get(d, 0)
        number[d] = first[d, c] + -(-n // SHARD)
    rows = [(d, c, first[d, c], -(-n // SHARD)) for d, c, n in sizes]
    table = F.broadcast(spark.createDataFrame(rows, "dim int, cluster long, first long, parts long"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return near.join(table, ["dim", "cluster"]).withColumn("shard", F.col("first") + part).drop("cluster", "first", "parts"), number


def top_k(spark: SparkSession, rows: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` largest integer inner products.

    ``rows`` has ``vec_id`` and ``embedding``. Components count as ``floor(scale * x)``. Queries are the rows whose
    vec_id is divisible by ``every``, candidates all rows of another vec_id and the same number of
    components. Rows take no part if vec_id or the vector is null or a component is null or not finite.
    Equal rows count once; rows that repeat a vec_id with another vector are candidates, and queries, of their own. Scores
    beyond 64 bits are ranked exactly and then cut to that range. Empty vectors score 0.
    """
    prepare(spark)
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    given = rows.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()
    given = cut(given.withColumn("dim", F.size("v")))
    counts = {r["dim"]: (r["n"], r["q"]) for r in given.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    placed, shards = _clustered(spark, given, {d: n for d, (n, _) in counts.items()})
    blocks = {d: -(-q // BLOCK) for d, (_, q) in counts.items()}
    # groups that keep the cluster busy even where queries are few, and runs that do not
    wanted = spark.sparkContext.defaultParallelism
    group = {d: max(1, min(GROUP, b * shards[d] // wanted)) for d, b in blocks.items()}
    run = {d: max(1, min(RUN, shards[d] * -(-blocks[d] // group[d]) // wanted)) for d in blocks}
    of = lambda table: F.element_at(F.create_map(*[F.lit(y).cast("long") for kv in {**table, -1: 1}.items() for y in kv]), F.col("dim").cast("long"))

    trees = placed.groupBy("dim", "shard").applyInPandas(_plant, "dim int, shard long, body binary")
    asked = given.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(1), F.col("vec_id"), F.col("v")), of(blocks)))
    asked = asked.groupBy("dim", "block").applyInPandas(_bundle, "dim int, block long, body binary")
    whole = lambda n, by: F.floor((n - 1) / by)
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    sides = [
        trees.where(of(blocks) > 0).withColumn("group", upto(whole(of(blocks), of(group)))).select("dim", F.floor(F.col("shard") / of(run)).alias("run"), "group", F.lit(True).alias("is_tree"), F.col("shard").alias("block"), "body"),
        asked.withColumn("run", upto(whole(of(shards), of(run)))).select("dim", "run", F.floor(F.col("block") / of(group)).alias("group"), F.lit(False).alias("is_tree"), "block", "body"),
    ]
    pairs = sum(-(-shards[d] // run[d]) * -(-blocks[d] // group[d]) for d in blocks)
    parts = max(1, min(pairs, 100_000))
    met = sides[0].union(sides[1]).repartition(parts, "dim", "run", "group").sortWithinPartitions("dim", "run", "group", "is_tree", "block")
    found = met.mapInArrow(_search(k), "block long, n long, query_id long, score long, vec_id long")
    order = Window.partitionBy("query_id", "block", "n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
