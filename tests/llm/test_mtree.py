import math

import numpy as np
import pytest
from pyspark.sql import Row

from millrace.llm import mtree as M


def brute(ids, vectors, every, k=5):
    out = []
    for q in sorted(i for i in ids if i % every == 0):
        query = vectors[ids.index(q)]
        scores = sorted((-int(v @ query), i) for i, v in zip(ids, vectors, strict=True) if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def table(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=v, score=1, rank=2, dim="x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank int, dim string")


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard,page", [(50, 8), (8192, 256)])
def test_equals_brute_force(spark, monkeypatch, shard, page):
    monkeypatch.setattr(M, "SHARD", shard)
    monkeypatch.setattr(M, "PAGE", page)
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "GROUP", 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    v = (centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 12)) * 0.2).astype(np.float32)
    v[50:60] = v[50]  # ties
    v[70] *= 9
    ids = list(range(400))
    df = table(spark, [(i, x.tolist()) for i, x in zip(ids, v, strict=True)])
    assert got(M.top_k(spark, df, every=10)) == brute(ids, np.floor(v.astype(np.float64) * 256).astype(np.int64), 10)


def test_triangle_inequality_saves_work():
    """In clustered vectors a query meets few of them, fewer still with what another tree gave, and none where that is better than all."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 2000
    v = np.rint(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 10).astype(np.int64)
    one, two = M.Tree(np.arange(3000), v[:3000]), M.Tree(np.arange(3000, 6000), v[3000:])
    want = sorted(((int(x @ v[0]), i) for i, x in enumerate(v)), key=lambda x: (-x[0], x[1]))[:5]
    best = one.search(-1, v[0], 5)
    alone = M.Tree(np.arange(3000, 6000), v[3000:])
    alone.search(-1, v[0], 5)
    assert two.search(-1, v[0], 5, best) == want
    assert one.computed < 1500 and two.computed <= alone.computed < 1500
    two.computed = 0
    assert two.search(-1, v[0], 5, [(10**9, -k) for k in range(5)]) == [(10**9, -k) for k in range(5)] and two.computed == 0


@pytest.mark.parametrize("size", [1 << 23, 1 << 40, (1 << 62) - 1])
def test_large_components_keep_their_tree(size):
    """Scores of any size are exact, and the tree still saves work."""
    rng = np.random.default_rng(5)
    centres = rng.uniform(-0.9, 0.9, size=(30, 6))
    v = ((centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 6)) * 0.002) * size).astype(np.int64)
    tree = M.Tree(np.arange(3000), v)
    for q in (0, 7, 99):
        scores = sorted(((sum(int(a) * int(b) for a, b in zip(x, v[q], strict=True)), i) for i, x in enumerate(v) if i != q), key=lambda x: (-x[0], x[1]))
        tree.computed = 0
        assert tree.search(q, v[q], 5) == scores[:5] and tree.computed < 2000
    small = M.Tree(np.arange(50), rng.integers(-9, 9, (50, 6)))
    scores = sorted(((sum(int(a) * int(b) for a, b in zip(x, v[0], strict=True)), int(i)) for i, x in zip(small.ids, small.vectors, strict=True)), key=lambda x: (-x[0], x[1]))
    assert small.search(-1, v[0], 5) == scores[:5]


def test_long_vectors_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 20)
    rng = np.random.default_rng(6)
    wide = rng.normal(size=(60, 3000)).astype(np.float32)
    rows = [(i * 5, x.tolist()) for i, x in enumerate(wide)]
    out = got(M.top_k(spark, table(spark, rows), every=50))
    assert out == brute([i for i, _ in rows], np.floor(wide.astype(np.float64) * 256).astype(np.int64), 50)
    # one id for many vectors: each is a query, and none a candidate of the others
    few = [(50, x[:4].tolist()) for x in wide[:30]] + [(i, x[:4].tolist()) for i, x in enumerate(wide[30:40], 1)]
    out = got(M.top_k(spark, table(spark, few), every=50))
    assert len(out) == 30 * 5 and {r[2] for r in out} <= set(range(1, 11))
    ints = np.floor(wide[:40, :4].astype(np.float64) * 256).astype(np.int64)
    want = sorted((50, n + 1, i, s) for q in ints[:30] for n, (s, i) in enumerate(sorted(((int(x @ q), i) for i, x in enumerate(ints[30:], 1)), key=lambda x: (-x[0], x[1]))[:5]))
    assert out == want


def test_centres_bound_the_sample(spark, monkeypatch):
    """Clusters far apart come into shards of their own, on whatever sample the centres are fitted."""
    monkeypatch.setattr(M, "SHARD", 50)
    monkeypatch.setattr(M, "SAMPLE", 64)
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(4, 8)) * 50)[np.arange(400) % 4] + rng.normal(size=(400, 8)) * 0.1
    ids = list(range(400))
    out = got(M.top_k(spark, table(spark, [(i, x.tolist()) for i, x in zip(ids, v.astype(np.float32), strict=True)]), every=20))
    assert out == brute(ids, np.floor(v.astype(np.float32).astype(np.float64) * 256).astype(np.int64), 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0, None]), (100, [math.nan, 1.0]), (150, None), (200, [3.0]), (250, []), (1, [1e30, 2.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0]), (300, [math.inf, 1.0]), (3, [-1.0, -1.0])]
    out = got(M.top_k(spark, table(spark, rows)))
    assert [r[:3] for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert out[0][3] == (1 << 63) - 1 and out[1][3] == 256 * 256 * 3
    assert got(M.top_k(spark, table(spark, []))) == []
    assert got(M.top_k(spark, table(spark, [(50, [1.0])]))) == []
