import itertools
import random

import numpy as np
import pytest

from millrace.llm import jaccard as J
from millrace.llm.common import shingle_sets, word_hashes
from tests.llm.util import corpus, documents, edit, jaccard_components, prose, shingles


def run(spark, rows):
    out = J.near_duplicates(spark, documents(spark, rows)).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed, 70)
    assert run(spark, rows) == jaccard_components(rows)


def test_large_groups(spark, monkeypatch):
    """Long lists: copies, near copies of one text, and chains of edits, which pivots alone do not join."""
    monkeypatch.setattr(J, "SHORT_LIST", 3)
    rng = random.Random(5)
    base, rows = prose(rng, 120), []
    rows += [(i, base) for i in range(15)]
    rows += [(100 + i, edit(rng, base, 0.02)) for i in range(30)]
    text = prose(rng, 90)
    for i in range(30):
        rows.append((200 + i, text))
        text = edit(rng, text, 0.02)
    rows += [(300 + i, prose(rng, 60) + " " + base) for i in range(12)]
    assert run(spark, rows) == jaccard_components(rows)


@pytest.mark.parametrize("piece", [4, 9])
def test_long_lists_in_pieces(spark, monkeypatch, piece):
    """Lists that one component leads, lists that none does, and strays among copies."""
    monkeypatch.setattr(J, "SHORT_LIST", 3)
    monkeypatch.setattr(J, "PIECE", piece)
    rng = random.Random(15)
    base, rows = prose(rng, 100), corpus(5, 20)
    rows += [(1000 + i, edit(rng, base, 0.01)) for i in range(30)]
    text = base
    for i in range(30):  # edits of edits leave the first text behind
        text = edit(rng, text, 0.03)
        rows.append((2000 + i, text))
    common = prose(rng, 30)
    rows += [(3000 + i, common + " " + prose(rng, 6)) for i in range(40)]
    want = jaccard_components(rows)
    assert len({c for _, c in want.values()}) > 10
    assert run(spark, rows) == want


@pytest.mark.parametrize("buffer", [24 << 20, 30_000])
def test_tokens_that_many_classes_of_a_buffer_share(spark, monkeypatch, buffer):
    """Three classes stand for a buffer's many: in one buffer or in several, with strays in others, small sets included."""
    monkeypatch.setattr(J, "SHORT_LIST", 4)
    monkeypatch.setattr(J, "HEAVY", 6)
    monkeypatch.setattr(J, "_BUFFER", buffer)
    rng = random.Random(16)
    base, other = prose(rng, 100), prose(rng, 80)
    rows = corpus(7, 30) + [(1000 + i, edit(rng, base, 0.01)) for i in range(60)]
    rows += [(2000 + i, edit(rng, other, 0.01)) for i in range(9)]
    text = base
    for i in range(25):
        text = edit(rng, text, 0.02)
        rows.append((3000 + i, text))
    small = "a b c d e f g h i j k l"
    rows += [(4000 + i, f"{small} x{i}") for i in range(20)] + [(5000 + i, f"y{i} {small}") for i in range(20)]
    assert run(spark, rows) == jaccard_components(rows)
    sets = {i: shingles(t) for i, t in rows}
    classes = {s for s in sets.values() if s}
    similar = {s: sum(s != o and 5 * len(s & o) >= 4 * len(s | o) for o in classes) for s in classes}
    assert {r.doc_id: r.n_links for r in J.near_duplicates(spark, documents(spark, rows)).collect()} == {i: similar.get(s, 0) for i, s in sets.items()}


def test_links_are_all_counted(spark, monkeypatch):
    """In long lists every pair of near copies counts, also within blocks and between them."""
    monkeypatch.setattr(J, "SHORT_LIST", 3)
    rng = random.Random(9)
    base, rows = prose(rng, 120), corpus(4, 30)
    rows += [(1000 + i, edit(rng, base, 0.01)) for i in range(40)]
    rows += [(2000 + i, rows[-1][1]) for i in range(3)]
    sets = {i: shingles(t) for i, t in rows}
    classes = {s for s in sets.values() if s}
    similar = {s: sum(s != o and 5 * len(s & o) >= 4 * len(s | o) for o in classes) for s in classes}
    want = {i: similar.get(s, 0) for i, s in sets.items()}
    assert max(want.values()) > 3
    for block in (256, 7):
        monkeypatch.setattr(J, "BLOCK", block)
        got = {r.doc_id: r.n_links for r in J.near_duplicates(spark, documents(spark, rows)).collect()}
        assert got == want
    assert {r.doc_id: r.component_id for r in J.duplicate_groups(spark, documents(spark, rows)).collect()} == {i: c for i, (_, c) in jaccard_components(rows).items()}


def test_shared_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = ([np.sort(rng.choice(400, n, replace=False)).astype(np.uint64) for n in sizes] for sizes in ((5, 200, 90), (300, 1)))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    monkeypatch.setattr(J, "COLUMNS", 7)
    assert J._shared(a, b).tolist() == want


def test_small_sets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    assert run(spark, rows) == jaccard_components(rows)


def test_boundary_of_similarity(spark):
    """Sets of 8 and 10 shingles with 8 in common are similar, with 9 and 11 and 8 in common they are not."""
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:12])), (2, " ".join(w[:14])), (3, " ".join(w[20:33])), (4, " ".join(w[21:36]))]
    assert run(spark, rows) == jaccard_components(rows)
    assert run(spark, rows)[2][1] == 1


def test_odd_tables(spark):
    assert run(spark, []) == {}
    out = J.near_duplicates(spark, documents(spark, [(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (7, None)])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == sorted([(4, 1, 4), (4, 1, 4), (7, 0, 7), (None, 0, None), (None, 1, 4)], key=str)


def by_rows(rows):
    """Brute force with a vertex for each row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in itertools.combinations(range(len(rows)), 2):
        if sets[x] and sets[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
            root[find(x)] = find(y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def by_operator(spark, rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(spark, documents(spark, rows)).collect()), key=str)


def test_repeated_doc_ids_with_other_texts(spark):
    """Every text of a doc_id takes part, in whatever order the rows come."""
    rng = random.Random(8)
    a, b = prose(rng, 80), prose(rng, 90)
    rows = [(5, a), (5, b), (7, b + " more"), (9, "more " + a)]
    want = by_rows(rows)
    assert {d: c for d, _, c in want} == {5: 5, 7: 5, 9: 5}
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 0, 3, 2], [2, 1, 3, 0]):
        assert by_operator(spark, [rows[i] for i in order]) == want


def test_few_doc_ids_for_many_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "SHORT_LIST", 3)
    rng = random.Random(10)
    rows = [(None if i % 11 == 0 else i % 7, t) for i, t in corpus(6, 60)]
    base = prose(rng, 100)
    rows += [(i % 5, edit(rng, base, 0.01)) for i in range(25)]
    assert by_operator(spark, rows) == by_rows(rows)


def test_very_long_document(spark):
    rng = random.Random(12)
    long = prose(rng, 300_000)
    assert len(long) > 1 << 20
    rows = [(1, long), (2, edit(rng, long, 0.001)), (3, prose(rng, 300_000)), (4, "x " * 500_000), (5, "x" * 3_000_000)]
    assert by_operator(spark, rows) == by_rows(rows)


def test_need_and_prefixes():
    for n in range(1, 40):
        for m in range(1, 40):
            for o in range(0, min(n, m) + 1):
                assert (o >= J.need(n, m, 4, 5)) == (5 * o >= 4 * (n + m - o))
        assert J.prefix_length(n, 4, 5) == n - -(-4 * n // 5) + J.SHARED
        if n > J.ALWAYS_SMALL:
            assert min(J.need(n, m, 4, 5) for m in range(-(-4 * n // 5), n * 5 // 4 + 1)) >= J.SHARED
    assert J.boundary({3: 1000}, 4, 5) >= 3 and J.boundary({}, 4, 5) == J.ALWAYS_SMALL


def test_hashes_in_pieces(monkeypatch):
    texts = ["", "A b", "word " * 30, "x" * 500, " lead and trail ", "é ß"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    from millrace.llm import common as C

    want, first = word_hashes(data, off)
    monkeypatch.setattr(C, "_PIECE", 20)
    monkeypatch.setattr(C, "_tables", {})
    got, first2 = word_hashes(data, off)
    assert (want == got).all() and (first == first2).all()
    assert [len(s) for s in shingle_sets(data, off, 5)] == [len(shingles(t)) for t in texts]
