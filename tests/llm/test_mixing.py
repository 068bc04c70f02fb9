import collections
import random
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import mixing as M
from tests.llm.util import corpus, documents, prose, words_of


def test_targets():
    assert M.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75.0, 37.5])
    assert M.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30.0, 120.0, 60.0])
    assert M.targets([0, 0], [5, 2]) == [0.0, 0.0] and M.targets([], []) == []


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_share_everything_under_the_cap(sizes):
    t = M.targets(sizes, [5, 2, 1] * 3)
    assert sum(t) == pytest.approx(sum(sizes))
    assert all(x <= 3 * n + 1e-9 for x, n in zip(t, sizes, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    for key in (1, 12345678901234567):
        assert sorted(M.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_shards_add_up():
    slots = np.array([9000, 3, 0, 4000])
    shards = -(-int(slots.sum()) // M.SHARD_SLOTS)
    parts = [M.shard_counts(slots, shards, s) for s in range(shards)]
    assert sum(p[1] for p in parts).tolist() == slots.tolist()
    assert all((parts[i][0] + parts[i][1] == parts[i + 1][0]).all() for i in range(shards - 1))
    assert max(int(p[1].sum()) for p in parts) <= M.SHARD_SLOTS


def big(seed=2):
    rng = random.Random(seed)
    rows = corpus(seed, 150)
    return rows + [(10_000 + i, prose(rng, rng.randrange(100, 900))) for i in range(200)]


def test_taken_words(spark):
    rows = big()
    docs = documents(spark, rows)
    out = M.taken_words(spark, docs).collect()
    again = M.taken_words(spark, docs.repartition(5)).collect()
    assert sorted(out) == sorted(again)
    assert {r.doc_id: r["size"] for r in out} == {i: len(words_of(t)) for i, t in rows}
    assert all(r.taken <= 3 * r["size"] for r in out)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        s = source[r.doc_id]
        taken[s] += r.taken
        size[s] += r["size"]
        target[s] = r.target
        assert r.source_size >= r["size"]
    assert {s: target[s] for s in ("s1", "s2", None)} == pytest.approx(dict(zip(["s1", "s2", None], M.targets([size["s1"], size["s2"], size[None]], [5, 2, 1]), strict=True)))
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s] + 2 * M.BLOCK


def xxhash_long(i, seed=42):
    """What Spark's xxhash64 gives for a long."""
    h = xxhash.xxh64(struct.pack("<q", i), seed=seed).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_taken(rows, source):
    """The mix without shards and tables: every source's slots one after the other."""
    sizes = {i: len(words_of(t)) for i, t in rows}
    names = sorted({source[i] for i in sizes}, key=lambda k: (k is None, k or ""))
    totals = [sum(n for i, n in sizes.items() if source[i] == k) for k in names]
    goal = M.targets(totals, [(5, 2, 1)[k % 3] for k in range(len(names))])
    taken = {}
    for s, name in enumerate(names):
        stretches = sum(source[i] == name for i in sizes) // M.STRETCH + 1
        own = sorted((i for i in sizes if source[i] == name), key=lambda i: (xxhash_long(i) % stretches, i))
        words = [i for i in own for _ in range(sizes[i])]
        length = min(64, max(1, totals[s] // 256))
        blocks = [words[k : k + length] for k in range(0, len(words), length)]
        slots = min(3 * len(blocks), round(goal[s] * len(blocks) / totals[s])) if totals[s] else 0
        got = collections.Counter()
        for turn in range(-(-slots // len(blocks)) if slots else 0):
            key = int(M.mix(np.array([M.SEED * 1_000_003 + s * 17 + turn], np.uint64))[0])
            for b in M.permute(np.arange(min(len(blocks), slots - turn * len(blocks))), len(blocks), key).tolist():
                got.update(blocks[b])
        taken |= {i: (got[i], totals[s]) for i in own}
    return taken


def test_taken_equals_plain_mix(spark):
    rows = big(5)
    docs = documents(spark, rows)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    got = {r.doc_id: (r.taken, r.source_size) for r in M.taken_words(spark, docs).collect()}
    assert got == plain_taken(rows, source)


def test_many_small_sources(spark):
    """Every source comes near its target, however small it is."""
    rng = random.Random(6)
    data = [(i, prose(rng, 8), f"host{i % 800:04}") for i in range(4000)]
    out = M.taken_words(spark, spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    taken, target = collections.Counter(), {}
    for r in out:
        assert r.taken <= 3 * r["size"]
        taken[r.doc_id % 800] += r.taken
        target[r.doc_id % 800] = r.target
    assert max(abs(taken[k] - t) for k, t in target.items()) <= 0.5 and len(target) == 800


def test_one_hot_source_and_small_ones(spark):
    rng = random.Random(7)
    data = [(i, prose(rng, 60), "a" if i % 10 else f"z{i}") for i in range(600)]
    out = M.taken_words(spark, spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    taken, target = collections.Counter(), {}
    for r in out:
        k = "a" if r.doc_id % 10 else r.doc_id
        taken[k] += r.taken
        target[k] = r.target
    assert all(abs(taken[k] - t) <= 1 + 0.01 * t for k, t in target.items())


def test_large_totals_are_split_by_the_same_law(monkeypatch):
    counts, left = np.array([700, 0, 250, 50]), 300
    small = np.array([M._split(counts, left, (1, k)) for k in range(3000)])
    monkeypatch.setattr(M, "LARGE", 1)
    large = np.array([M._split(counts, left, (2, k)) for k in range(3000)])
    assert (large.sum(axis=1) == left).all() and (large >= 0).all() and (large <= counts).all()
    assert np.allclose(small.mean(axis=0), large.mean(axis=0), atol=0.5)
    assert np.allclose(small.std(axis=0), large.std(axis=0), rtol=0.08)
    monkeypatch.setattr(M, "LARGE", 10**9)
    huge = np.array([7 * 10**11, 5, 3 * 10**11])
    got = M._split(huge, 4 * 10**11, (3,))
    assert got.sum() == 4 * 10**11 and abs(got[0] - 2.8e11) < 1e7 and (got <= huge).all()


def test_very_long_and_repeated_rows(spark):
    rows = [(1, "word " * 400_000), (2, "a b c"), (2, "a b c"), (2, "d e"), (4, "x" * 2_000_000)]
    out = M.taken_words(spark, documents(spark, rows)).collect()
    again = M.taken_words(spark, documents(spark, rows).repartition(3)).collect()
    assert sorted((r["size"]) for r in out) == [1, 2, 3, 3, 400_000] and sorted(out) == sorted(again)
    assert all(r.taken <= 3 * r["size"] for r in out)


def test_documents_follow_the_mix(spark):
    docs = documents(spark, big(3))
    out = M.mix_documents(spark, docs)
    assert out.columns == docs.columns
    n = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    taken = {r.doc_id: r for r in M.taken_words(spark, docs).collect()}
    for i, r in taken.items():
        assert abs(n[i] - r.taken / r["size"]) < 1 if r["size"] else n[i] == 1


def test_odd_tables(spark):
    assert M.taken_words(spark, documents(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a"), (3, "a")]
    out = M.taken_words(spark, documents(spark, rows)).collect()
    assert len(out) == 5 and all(r.taken <= 3 * r["size"] for r in out)
    assert M.mix_documents(spark, documents(spark, rows)).count() >= 2
