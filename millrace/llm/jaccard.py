"""Similarity join on word shingles: a size-aware heavy-light join under Jaccard similarity.

Documents with the same shingle set form a class, named by a 128-bit fingerprint of the set, and
only classes are compared. The join has two sides (Deng, Tao and Li, "Overlap set similarity joins
with theoretical guarantees", SIGMOD 2018, carried over from overlap to Jaccard):

* *Small sets* enumerate their subsets of fixed sizes. Sets of n and m shingles are similar when
  they share ``need(n, m)`` shingles; for each such size up to the boundary both enumerate all
  subsets of it, so similar small sets meet in a common subset.
* *Large sets* scan inverted lists. All sets follow one order of shingles, the rare before the
  frequent; similar sets share ``SHARED`` of their first ``n - ceil(t * n) + SHARED`` shingles.

The *boundary* between them is where the estimated number of list entries, from the histogram of
set sizes, is least. Small sets that can be similar to a large one also enter the lists.

Entries travel as packed arrays by hash bucket. Lists of up to 16 classes give their pairs after
size and position filters, and pairs that meet in ``SHARED`` lists are candidates; in longer lists all members are compared with three pivots first,
and only members which that has not joined into one component are compared with each other.
So copies and near copies in large groups cost a few comparisons each, and no link that would change
a component is lost. The links inside a component of members of long lists are counted afterwards,
block of members by block, by products of their incidence matrices, so that none is missing from the
counts and no pair is written. Candidates whose outlines (shingle counts in 256 hash ranges) already rule out
enough common shingles go; the rest are verified on the exact sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bit_table, cut, lean, mix, narrow, prepare, release, shingle_sets, slices, table_bits, utf8, wide
from millrace.llm.graph import components, merge_components

#: Similarity as a fraction of integers, so that the test is exact.
SIMILARITY = (80, 100)
WIDTH = 5
#: Lists of large sets in which a pair must meet.
SHARED = 3
#: Sets up to this size always enumerate subsets; beyond it, similar sets have SHARED shingles in common.
ALWAYS_SMALL = 4
#: Classes in a list up to which all its pairs are candidates at once.
SHORT_LIST = 16
#: Occurrences from which a shingle counts as frequent and comes late in the order.
FREQUENT = 16
#: Bits of the table that marks frequent shingles by hash; its size does not depend on the data.
MARKS = 23
#: List entries that a bucket is meant to hold.
BUCKET_ENTRIES = 1_500_000
#: Cost of an entry in an inverted list, its comparisons included, in subset entries.
SCAN_COST = 8
#: Hash ranges in the outline of a set.
RANGES = 256
#: Sets beyond FINE_FROM shingles have FINE ranges; those beyond LARGE might not fit a byte a range, and are never ruled out.
FINE, FINE_FROM, LARGE = 1024, 700, 100_000
#: Members of a long list that are compared in one piece.
PIECE = 5000
#: Members, and shingles together, that a block of a component is meant to hold when its links are counted.
BLOCK, BLOCK_SHINGLES = 256, 500_000
#: Columns of an incidence matrix at a time.
COLUMNS = 4096
#: Classes that have a token within one buffer from which on only three of them go to the token's bucket.
HEAVY = 64
#: The places of entries that are subsets, and of those that stand for a buffer's many; lesser places are true.
SUBSET, STANDS = 65535, 65534
_BUFFER = 24 << 20
_SURVEYED = 32 << 20
_U = np.uint64


def need(n, m, num: int = SIMILARITY[0], den: int = SIMILARITY[1]):
    """Shared shingles from which sets of n and m are similar: the least o with o/(n+m-o) >= num/den."""
    return -((-num * (n + m)) // (num + den))


def prefix_length(n, num: int = SIMILARITY[0], den: int = SIMILARITY[1]):
    """The SHARED-th common shingle of similar sets has ``need - SHARED`` more behind it, so it is among the first so many."""
    return n + ((-num * n) // den) + SHARED


def subset_sizes(n: int, most: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a small set of n enumerates, partners having at most ``most``."""
    partners = range(-(-num * n // den), min(most, n * den // num) + 1)
    return sorted({need(n, m, num, den) for m in partners if need(n, m, num, den) <= min(n, m)})


def boundary(histogram: dict[int, int], num: int, den: int, most: int = 24) -> int:
    """The set size up to which enumerating subsets is estimated to cost less than scanning lists."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in histogram.items():
            if n <= x:
                total += count * sum(math.comb(n, c) for c in subset_sizes(n, x, num, den))
            if n * den // num > x:
                total += count * prefix_length(n, num, den) * SCAN_COST
        return total

    return min(range(ALWAYS_SMALL, most + 1), key=lambda x: (cost(x), x))


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    """The two fingerprints and the size of each set."""
    out = np.zeros((len(sets), 3), _U)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = mix(s).sum(dtype=_U), mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U), len(s)
    return out


def _outline(s: np.ndarray) -> bytes:
    ranges = FINE if len(s) > FINE_FROM else RANGES
    return np.minimum(np.bincount((s >> _U(54)).astype(np.int64) * ranges // FINE, minlength=ranges), 255).astype(np.uint8).tobytes()


def _coarse(outline: bytes) -> np.ndarray:
    """An outline in RANGES ranges."""
    return np.frombuffer(outline, np.uint8).reshape(RANGES, -1).sum(axis=1, dtype=np.uint16)


def _outlines_allow(n1: int, s1: bytes, n2: int, s2: bytes, num: int, den: int) -> bool:
    """Whether two outlines leave room for enough common shingles."""
    if max(n1, n2) > LARGE:
        return True
    if len(s1) == len(s2):
        room = np.minimum(np.frombuffer(s1, np.uint8), np.frombuffer(s2, np.uint8)).sum(dtype=np.int64)
    else:
        room = np.minimum(_coarse(s1), _coarse(s2)).sum(dtype=np.int64)
    return bool(room >= need(n1, n2, num, den))


def _sets(batch, width: int):
    data, off, _ = utf8(batch.column("text"))
    for a, b in slices(off):
        yield a, b, shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], width)


def _survey(width: int):
    """Of each document its class; of each buffer the shingles that several of its classes have."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[bytes, np.ndarray] = {}
        held = 0

        def frequent():
            tokens = np.sort(np.concatenate([*seen.values(), np.zeros(0, _U)]))
            seen.clear()
            edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]])) if len(tokens) else np.zeros(1, int)
            count = np.diff(edge)
            often = count >= 2
            n = int(often.sum())
            return pa.record_batch(
                [pa.nulls(n, pa.int64()), pa.array(count[often].astype(np.int64)), pa.array(tokens[edge[:-1]][often].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.ones(n, bool)), pa.nulls(n, pa.binary())],
                names=["doc_id", "n_shingles", "k0", "k1", "frequent", "outline"],
            )

        for batch in batches:
            rows, outlines = [], []
            for _, _, sets in _sets(batch, width):
                own = _classes(sets)
                rows.append(own)
                outlines += [_outline(s) for s in sets]
                for key, s in zip(own, sets, strict=True):
                    if (name := key.tobytes()) not in seen and len(s):
                        seen[name] = s
                        held += s.nbytes
                if held > _SURVEYED:
                    yield frequent()
                    held = 0
            if rows:
                own = np.concatenate(rows).view(np.int64)
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(own[:, 2].copy()), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy()), pa.array(np.zeros(len(own), bool)), pa.array(outlines, pa.binary())],
                    names=["doc_id", "n_shingles", "k0", "k1", "frequent", "outline"],
                )
        yield frequent()

    return lean(run)


def _subset_hashes(s: np.ndarray, size: int) -> np.ndarray:
    """A hash of each subset of that size."""
    n = len(s)
    if size == n:
        sums = s.sum(dtype=_U, keepdims=True)
    elif size == n - 1:
        sums = s.sum(dtype=_U) - s
    else:
        from itertools import combinations

        sums = s[np.fromiter((i for c in combinations(range(n), size) for i in c), np.int64).reshape(-1, size)].sum(axis=1, dtype=_U)
    return mix(sums ^ _U(size * 0x9E3779B97F4A7C15 % (1 << 64)))


def _stand_ins(t: np.ndarray, p: np.ndarray, o: np.ndarray, n_of: np.ndarray, num: int, den: int):
    """The entries (token, place, owner) of a buffer that go to buckets, and what is found of tokens that ``HEAVY`` owners share.

    Of such tokens: pairs of owners to be compared, one of each pair being one of three pivots; all entries; and their places.
    """
    if len(t) < HEAVY:
        return None, None
    h = t >> _U(16)
    by_token = np.sort(h)
    many = np.unique(by_token[HEAVY - 1 :][by_token[HEAVY - 1 :] == by_token[: len(h) - HEAVY + 1]])
    if not len(many):
        return None, None
    some = np.flatnonzero(np.isin(h, many))
    order = some[np.lexsort((o[some], h[some]))]
    keep = np.ones(len(order), bool)  # an owner counts once
    keep[1:] = (h[order[1:]] != h[order[:-1]]) | (o[order[1:]] != o[order[:-1]])
    order = order[keep]
    edge = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]], [True]]))
    length = np.diff(edge)
    if length.max() < HEAVY:
        return None, None
    gone = np.zeros(len(t), bool)
    pairs, far = [], []
    for a, m in zip(edge[:-1][length >= HEAVY].tolist(), length[length >= HEAVY].tolist(), strict=True):
        rows = order[a : a + m]
        rows = rows[np.argsort(n_of[o[rows]], kind="stable")]
        pivots = rows[[0, m // 2, m - 1]]
        gone[rows] = True
        gone[pivots] = False
        far.append(rows)
        for k in pivots.tolist():
            two = np.stack([np.full(m, o[k]), o[rows]], 1)
            pairs.append(two[(two[:, 0] != two[:, 1]) & _may(n_of[two[:, 0]], 0, n_of[two[:, 1]], 0, num, den)])
    far = np.concatenate(far)
    pairs = np.concatenate(pairs).astype(np.int64)
    pairs = np.unique(np.stack([pairs.min(axis=1), pairs.max(axis=1)], 1), axis=0)
    return np.flatnonzero(~gone), (pairs, far, np.where(p[far] == SUBSET, 0, p[far]))


def _past(pdf, num: int, den: int):
    """What ``_entries`` found itself, as ``_match`` gives it."""
    import pandas as pd
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    frames = []
    for row in zip(pdf["tokens"], pdf["owners"], pdf["places"], pdf["classes"], strict=True):
        t, o, p, c = (unpack(x) for x in row)
        own, two = np.frombuffer(o, np.int64).reshape(-1, 2), np.frombuffer(c, np.int64).reshape(-1, 4)
        # the order of the sides is that of _match, so that a pair found in both is one
        back = (two[:, 0].view(_U) > two[:, 2].view(_U)) | (two[:, 0] == two[:, 2]) & (two[:, 1] > two[:, 3])
        two = np.where(back[:, None], two[:, [2, 3, 0, 1]], two)
        frames.append(pd.DataFrame({"token": None, "a0": two[:, 0], "a1": two[:, 1], "b0": two[:, 2], "b1": two[:, 3], "place": SHARED}).astype("Int64"))
        frames.append(pd.DataFrame({"token": np.frombuffer(t, np.int64), "a0": own[:, 0], "a1": own[:, 1], "b0": None, "b1": None, "place": np.frombuffer(p, np.int64)}).astype("Int64"))
    return pd.concat(frames, ignore_index=True)


def _entries(width: int, num: int, den: int, small: int, marks, buckets: int):
    """List entries of each class, packed by hash bucket.

    An entry is a token (subset or shingle), the class, and the shingle's place in the order (for subsets
    ``SUBSET``). It travels in eight bytes: 48 bits of the token, a chance match being a candidate more to
    verify, and the place below ``STANDS``, a lesser place only weakening the filter. Classes are given by one
    fingerprint and the size, with how many entries each has; names that coincide mean candidates more, too.

    Where ``HEAVY`` classes of a buffer share a token, as near copies do, they are compared with three of them
    here, and only these go to the bucket. So a bucket has three entries of such a token for each buffer, however many
    copies there are. The pairs and the members of the list go past the buckets, in rows with a negative one.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        frequent = np.unpackbits(np.frombuffer(marks.value, np.uint8))
        names: dict[bytes, int] = {}
        known: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        places: list[np.ndarray] = []
        held = 0

        def flush():
            if not tokens:
                return
            t, p = np.concatenate(tokens), np.concatenate(places).astype(np.uint16)
            o = np.repeat(np.array([x for x, _ in owners], np.uint32), [k for _, k in owners])
            table = np.stack(known)
            few, members = _stand_ins(t, p, o, table[:, 2].astype(np.int64), num, den)
            if members is not None:
                pairs, far, far_place = members
                token, key = (t[far] >> _U(16)).view(np.int64), table.view(np.int64)
                piece = 1 << 13
                for rows in range(0, max(len(far), len(pairs)), piece):
                    cut_, two = slice(rows, rows + piece), pairs[rows : rows + piece]
                    blobs = [token[cut_], key[o[far[cut_]]][:, [0, 2]], far_place[cut_].astype(np.int64), np.concatenate([key[two[:, 0]][:, [0, 2]], key[two[:, 1]][:, [0, 2]]], 1)]
                    hold = [pack(np.ascontiguousarray(x).tobytes()) for x in blobs]
                    past = -1 - int((table[0, 0] + _U(rows // piece)) % _U(buckets))
                    yield pa.record_batch([pa.array([past], pa.int64()), *(pa.array([x], pa.binary()) for x in hold)], names=["bucket", "tokens", "owners", "places", "classes"])
                t, p, o = t[few], p[few], o[few]
                p[np.isin(few, far)] = STANDS
            b = (t >> _U(20)) % _U(buckets)
            order = np.argsort(b, kind="stable")
            t, p, o, b = t[order], p[order], o[order], b[order]
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
            out: list[list] = [[], [], [], [], []]
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own, many = np.unique(o[x:y], return_counts=True)  # ascending already
                for col, v in zip(out, (int(b[x]), narrow(t[x:y]), many.astype(np.uint32).tobytes(), p[x:y].tobytes(), table[own, 0].tobytes() + table[own, 2].astype(np.uint32).tobytes()), strict=True):
                    col.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "tokens", "owners", "places", "classes"])
            for x in (names, known, tokens, owners, places):
                x.clear()

        for batch in batches:
            for _, _, sets in _sets(batch, width):
                for key, s in zip(_classes(sets), sets, strict=True):
                    n = len(s)
                    if not n or (name := key.tobytes()) in names:
                        continue
                    names[name] = len(known)
                    if n <= small:
                        for c in subset_sizes(n, small, num, den):
                            h = _subset_hashes(s, c)
                            tokens.append(h)
                            places.append(np.full(len(h), SUBSET, np.uint32))
                            owners.append((len(known), len(h)))
                    if n * den // num > small:
                        late = frequent[(s >> _U(64 - MARKS)).astype(np.int64)].astype(bool)
                        first = np.concatenate([s[~late], s[late]])[: prefix_length(n, num, den)]
                        tokens.append(first)
                        places.append(np.minimum(np.arange(len(first), dtype=np.uint32), STANDS - 1))
                        owners.append((len(known), len(first)))
                    known.append(key)
                    held += 16 * sum(len(x) for x in tokens[-1:])
                if held > _BUFFER:
                    yield from flush()
                    held = 0
        yield from flush()

    return lean(run)


def _may(n1, p1, n2, p2, num: int, den: int):
    """Whether sizes, and places of one of the first SHARED common shingles, let two sets be similar."""
    least = need(n1, n2, num, den)
    return (np.minimum(n1, n2) >= least) & (SHARED - 1 + np.minimum(n1 - p1, n2 - p2) >= least)


def _match(num: int, den: int):
    """Pairs from one bucket's lists, with the number of lists in ``place``; long lists come back whole for the second round."""

    def run(pdf):
        import pandas as pd

        if pdf["bucket"].iloc[0] < 0:
            return _past(pdf, num, den)
        base, parts = 0, []
        for t, o, p, c in zip(pdf["tokens"], pdf["owners"], pdf["places"], pdf["classes"], strict=True):
            m = len(c) // 12
            c = np.stack([np.frombuffer(c[: 8 * m], _U), np.frombuffer(c[8 * m :], np.uint32).astype(_U)], 1)
            parts.append((wide(t), np.repeat(np.arange(len(c)), np.frombuffer(o, np.uint32)) + base, np.frombuffer(p, np.uint16), c))
            base += len(c)
        table = np.concatenate([x[3] for x in parts])
        uniq, ids = np.unique(table, axis=0, return_inverse=True)
        n_of = uniq[:, 1].astype(np.int64)
        t = np.concatenate([x[0] for x in parts])
        o = ids.reshape(-1)[np.concatenate([x[1] for x in parts])]
        p = np.concatenate([x[2] for x in parts]).astype(np.int64)
        order = np.argsort(t, kind="stable")
        t, o, p = t[order], o[order], p[order]
        # lists of one class are of no use, and most lists have a single entry
        near = np.zeros(len(t), bool)
        near[1:] = t[1:] == t[:-1]
        near[:-1] |= near[1:].copy()
        t, o, p = t[near], o[near], p[near]
        # an entry that stands for others comes before the same class's entry from another buffer, and stays
        order = np.lexsort((np.where(p == STANDS, -1, p), o, n_of[o], t))
        t, o, p = t[order], o[order], p[order]
        keep = np.ones(len(t), bool)
        keep[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o, p = t[keep], o[keep], p[keep]
        edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])) if len(t) else np.zeros(1, int)
        start, length = edge[:-1], np.diff(edge)
        left, right, weight, longer = [], [], [], []
        subset, stands = p == SUBSET, p == STANDS
        p = np.where(subset | stands, 0, p)
        # a list is long by its length, or because a buffer had many of its members
        marked = np.add.reduceat(stands, start) > 0 if len(t) else np.zeros(0, bool)
        for m in np.unique(length).tolist():
            if m < 2:
                continue
            if m <= SHORT_LIST:
                rows = start[(length == m) & ~marked]
                i, j = np.triu_indices(m, 1)
                a, b = (rows[:, None] + i).ravel(), (rows[:, None] + j).ravel()
                ok = _may(n_of[o[a]], p[a], n_of[o[b]], p[b], num, den)
                w = np.where(subset[a] | subset[b], SHARED, 1)  # a common subset is enough by itself
                left.append(o[a[ok]])
                right.append(o[b[ok]])
                weight.append(w[ok])
            rows = start[(length == m) & marked] if m <= SHORT_LIST else start[length == m]
            if len(rows):
                every = (rows[:, None] + np.arange(m)).ravel()
                longer.append(every[~stands[every]])  # the others are known from their buffers
                pivots = [np.repeat(rows + k, m) for k in (0, m // 2, m - 1)]
                a, b = np.concatenate(pivots), np.tile(every, 3)
                ok = (a != b) & _may(n_of[o[a]], 0, n_of[o[b]], 0, num, den)
                left.append(o[a[ok]])
                right.append(o[b[ok]])
                weight.append(np.full(int(ok.sum()), SHARED))  # the pivots' pairs are candidates whatever else they share
        left = np.concatenate([*left, np.zeros(0, np.int64)])
        right = np.concatenate([*right, np.zeros(0, np.int64)])
        weight = np.concatenate([*weight, np.zeros(0, np.int64)])
        pairs, same = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0, return_inverse=True)
        lists = np.minimum(np.bincount(same.reshape(-1), weight, len(pairs)), SHARED).astype(np.int64)
        k = uniq.view(np.int64)
        far = np.concatenate([*longer, np.zeros(0, np.int64)])
        frames = [
            pd.DataFrame({"token": None, "a0": k[pairs[:, 0], 0], "a1": k[pairs[:, 0], 1], "b0": k[pairs[:, 1], 0], "b1": k[pairs[:, 1], 1], "place": lists}),
            pd.DataFrame({"token": t[far].view(np.int64), "a0": k[o[far], 0], "a1": k[o[far], 1], "b0": None, "b1": None, "place": p[far]}),
        ]
        out = pd.concat([f.astype("Int64") for f in frames], ignore_index=True)
        release()
        return out

    return run


def _cross(num: int, den: int):
    """Pairs of one piece of a long list whose classes are not in one component yet.

    Where rows have sides, only pairs of different sides count.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["n", "node"], kind="stable")
        node, label, n, p, side = (pdf[c].to_numpy() for c in ("node", "label", "n", "place", "side"))
        sides = side.max() > 0
        outline = pdf["outline"].tolist()
        coarse = np.stack([_coarse(x) for x in outline])
        last = np.searchsorted(n, n * den // num, "right")
        left, right = [], []
        for i in range(len(node)):
            j = np.arange(i + 1, last[i])
            j = j[(label[j] != label[i]) & _may(n[i], p[i], n[j], p[j], num, den)]
            if sides:
                j = j[side[j] != side[i]]
            room = np.minimum(coarse[i], coarse[j]).sum(axis=1, dtype=np.int64)
            j = j[(room >= need(n[i], n[j], num, den)) | (n[j] > LARGE)]
            j = j[[_outlines_allow(int(n[i]), outline[i], int(n[k]), outline[k], num, den) for k in j.tolist()]] if len(j) else j
            if len(j):
                left.append(np.full(len(j), node[i]))
                right.append(node[j])
        return pd.DataFrame({"a": np.concatenate([*left, np.zeros(0, np.int64)]), "b": np.concatenate([*right, np.zeros(0, np.int64)])})

    return run


def _pieces(lists: DataFrame) -> Iterator[DataFrame]:
    """Lists of several components as pieces ``(token, i, j, side, ...)`` of at most some ``PIECE`` rows, which hold all pairs across components.

    A list of one piece stays whole. In a longer one that one component dominates, as a group of copies does, its rows are
    dealt over pieces, and those of the others go to each of them, on the other side; the others among themselves
    are a list of at most half the length, and so on. Where no component has half of a list, each pair of its
    pieces is one.
    """
    own = ["token", "node", "n", "place", "outline", "label"]
    zero = F.lit(0).cast("long")
    while True:
        per = lists.groupBy("token", "label").agg(F.count("*").alias("c"))
        sizes = per.groupBy("token").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
        sizes = cut(sizes.select("token", "m", F.col("top.c").alias("c"), F.col("top.label").alias("top"), F.ceil(F.col("m") / PIECE).alias("pieces")))
        most = sizes.agg(F.max("pieces")).first()[0]
        if not most:
            return
        rows = lists.join(sizes, "token")
        piece = F.pmod(F.xxhash64("node"), "pieces")
        yield rows.where("pieces = 1").select(*own, zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"))
        if most == 1:
            return
        large = cut(rows.where("pieces > 1").select(*own, "top", "pieces", (F.col("c") * 2 >= F.col("m")).alias("led"), piece.alias("piece")))
        every = F.explode(F.sequence(zero, F.col("pieces") - 1))
        main, others = large.where("led and label = top"), large.where("led and label <> top")
        yield main.select(*own, F.col("piece").alias("i"), zero.alias("j"), F.lit(0).alias("side"))
        yield others.withColumn("i", every).select(*own, "i", zero.alias("j"), F.lit(1).alias("side"))
        pairs = large.where("not led").withColumn("other", every)
        side = F.when(F.col("piece") > F.col("other"), 1).otherwise(0)
        yield pairs.select(*own, F.least("piece", "other").alias("i"), (F.greatest("piece", "other") + 1).alias("j"), side.alias("side"))
        lists = others.select(*own)


def _rule_out(num: int, den: int):
    """Drops candidate pairs whose outlines leave no room for enough common shingles."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("n_a", "outline_a", "n_b", "outline_b")]
            mask = pa.array([_outlines_allow(*row, num, den) for row in zip(*sides, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return lean(run)


def _pack(width: int, wanted, bits: int):
    """Classes and sets of the documents that the table of wanted ones marks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        marked = np.unpackbits(np.frombuffer(wanted.value, np.uint8))
        for batch in batches:
            at = np.asarray(batch.column("at"))
            batch = batch.filter(pa.array(marked[at].astype(bool)))
            for a, b, sets in _sets(batch, width):
                own = _classes(sets).view(np.int64)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "k0", "k1", "set"],
                )

    return lean(run)


def _verify(num: int, den: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return lean(run)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    if not len(both):
        return out
    cells = []
    for t, row in ((a, row_a), (b, row_b)):
        col = np.minimum(np.searchsorted(both, t), len(both) - 1)
        ok = both[col] == t
        order = np.argsort(col[ok], kind="stable")
        cells.append((col[ok][order], row[ok][order]))
    for x in range(0, len(both), COLUMNS):
        sides = []
        for (col, row), n in zip(cells, out.shape, strict=True):
            p, q = np.searchsorted(col, [x, x + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(both) - x)), np.float32)
            m[row[p:q], col[p:q] - x] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _count(num: int, den: int):
    """The links of each member of a block with those of another block, or with its own, in one component."""

    def run(pdf):
        import pandas as pd

        nodes, links = [], []
        for _, part in pdf.groupby("component", sort=False):
            i, j = part["i"].iloc[0], part["j"].iloc[0]
            sides = [part[part["block"] == k] for k in (i, j)]
            if not len(sides[0]) or not len(sides[1]):
                continue
            sets = [[np.frombuffer(x, _U) for x in side["set"]] for side in sides]
            shared = _shared(*sets)
            n, m = (np.array([len(x) for x in side]) for side in sets)
            similar = den * shared >= num * (n[:, None] + m[None, :] - shared)
            if i == j:
                np.fill_diagonal(similar, False)
            nodes.append(sides[0]["node"].to_numpy())
            links.append(similar.sum(axis=1))
            if i != j:
                nodes.append(sides[1]["node"].to_numpy())
                links.append(similar.sum(axis=0))
        return pd.DataFrame({"node": np.concatenate([*nodes, np.zeros(0, np.int64)]), "n_links": np.concatenate([*links, np.zeros(0, np.int64)])})

    return run


@dataclass
class Classes:
    """``table(node, first, n_shingles, k0, k1, outline)``: the classes of equal sets, by name.

    ``first`` is the smallest doc_id of a class. It is its name, too, unless some doc_id stands for rows with
    different sets (``mixed``): then names are hashes of ``first`` and the class.
    """

    table: DataFrame
    mixed: bool

    def name(self, doc_id: str) -> Column:
        """The name of the class, k0 and k1, whose smallest doc_id is given."""
        return F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id, "k0", "k1")) if self.mixed else F.col(doc_id)

    def documents_of(self, nodes: DataFrame) -> DataFrame:
        """``doc_id`` of a document of each of ``nodes(node)``."""
        return nodes.join(self.table.select("node", F.col("first").alias("doc_id")), "node").select("doc_id").distinct() if self.mixed else nodes.select(F.col("node").alias("doc_id"))

    def first_of(self, label: DataFrame) -> DataFrame:
        """``label(node, component)`` with the smallest doc_id of each component as its name, and r0 and r1, the class that has it.

        Where no doc_id has several sets the name says which class it is, and r0 and r1 are null.
        """
        if not self.mixed:
            none = F.lit(None).cast("long")
            return label.select("node", "component", none.alias("r0"), none.alias("r1"))
        least = label.join(self.table.select("node", "first", "k0", "k1"), "node").groupBy("component").agg(F.min(F.struct("first", "k0", "k1")).alias("least"))
        return label.join(least, "component").select("node", F.col("least.first").alias("component"), F.col("least.k0").alias("r0"), F.col("least.k1").alias("r1"))


def _wanted_sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, classes: Classes, width: int) -> DataFrame:
    """``(node, set)`` of the classes in ``wanted(node)``.

    Only wanted documents' sets are built. A table of bits, whose size is bounded, keeps most others'
    texts out of the exchange; a semi join takes out the rest.
    """
    bits = table_bits(wanted.count())
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    marked = bit_table(spark, classes.documents_of(wanted).select(at.alias("at")), bits)
    sets = docs.where("doc_id is not null").withColumn("at", at).mapInArrow(_pack(width, marked, bits), "doc_id long, k0 long, k1 long, set binary")
    sets = sets.select(classes.name("doc_id").alias("node"), "set")
    # rows of one name have equal sets, so any will do
    return cut(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))


def _verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, classes: Classes, width: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)``, given by name, whose sets are similar."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = _wanted_sets(spark, docs, wanted, classes, width)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"
    )
    return cut(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(num, den), "a long, b long"))


def _degrees(spark: SparkSession, docs: DataFrame, found: Found, width: int, num: int, den: int) -> DataFrame:
    """``(node, n_links)``, with no link missing.

    A link that ``links`` lacks is between two members of long lists, in one component. So pairs of
    members of long lists are all counted here, and from ``links`` only the others. Each pair of
    blocks of a component is a group, and gives a row for each member.
    """
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    links = found.links
    if found.listed is None:
        return ends(links)
    inner = cut(found.listed.join(found.label, "node"))
    per = inner.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("s")).where("k > 1")
    per = cut(per.select("component", "s", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("long").alias("blocks")))
    buckets = (per.where("blocks = 1").agg(F.sum("s")).first()[0] or 0) // BLOCK_SHINGLES + 1
    placed = cut(inner.join(per.drop("s"), "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")))
    sets = _wanted_sets(spark, docs, placed.select("node"), found.classes, width)
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = F.col("blocks") == 1
    dealt = other.join(sets, "node").select(
        F.when(whole, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(-1).alias("bucket"),
        F.when(whole, 0).otherwise(F.col("component")).alias("of"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "component", "block", "node", "set",
    )
    counted = dealt.groupBy("bucket", "of", "i", "j").applyInPandas(_count(num, den), "node long, n_links long")
    mark = lambda k: inner.select(F.col("node").alias(k), F.lit(True).alias(f"{k}_in"))
    outside = links.join(mark("a"), "a", "left").join(mark("b"), "b", "left").where("a_in is null or b_in is null")
    return cut(counted.where("n_links > 0").union(ends(outside)).groupBy("node").agg(F.sum("n_links").alias("n_links")))


@dataclass
class Found:
    """The result of the join.

    ``members(doc_id, n_shingles, k0, k1, node)`` has a row for each row of the documents, node being the name of its
    class (null where the set is empty or no row of the class has a doc_id), ``links(a, b)`` stand between names, and
    ``label(node, component)`` has the names that have links. The links connect all that is similar; in
    long lists those inside a component already found may be left out, and ``listed(node, n)`` has the
    names in long lists, or is None where there are none: ``_degrees`` counts all links with it.
    """

    members: DataFrame
    links: DataFrame
    label: DataFrame
    listed: DataFrame | None
    classes: Classes


def similarity_classes(spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> Found:
    """Classes of equal shingle sets, and the verified links between them.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. Null texts and texts without words have
    empty sets. Rows without doc_id are counted as members but are not named. Rows that repeat a doc_id with the
    same set count as one; with different sets, each set is linked by itself.
    """
    prepare(spark)
    num, den = (x // math.gcd(*similarity) for x in similarity)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = cut(docs.mapInArrow(_survey(width), "doc_id long, n_shingles long, k0 long, k1 long, frequent boolean, outline binary"))
    own = survey.where("not frequent").drop("frequent", "outline")
    several = own.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct("k0", "k1")).alias("x"), F.max(F.struct("k0", "k1")).alias("y"))
    mixed = bool(several.where("x <> y").limit(1).count())
    grouped = survey.where("n_shingles > 0 and not frequent").groupBy("n_shingles", "k0", "k1")
    grouped = grouped.agg(F.min("doc_id").alias("first"), F.max("outline").alias("outline"))
    classes = Classes(None, mixed)
    classes.table = cut(grouped.withColumn("node", classes.name("first")))

    # frequent shingles as a table of bits: at most 2^MARKS of them, whatever the input
    often = survey.where("frequent").groupBy("k0").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= FREQUENT)
    marks = bit_table(spark, often.select(F.shiftrightunsigned("k0", 64 - MARKS).alias("at")), MARKS)

    sizes = classes.table.groupBy(F.least(F.col("n_shingles"), F.lit(32)).alias("n")).agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s")).collect()
    small = boundary({r["n"]: r["c"] for r in sizes if r["n"] < 32}, num, den)
    entries = sum(r["s"] for r in sizes) * (den - num) // den + sum(r["c"] for r in sizes)
    buckets = entries // BUCKET_ENTRIES + 1

    packed = docs.mapInArrow(_entries(width, num, den, small, marks, buckets), "bucket long, tokens binary, owners binary, places binary, classes binary")
    found = cut(packed.groupBy("bucket").applyInPandas(_match(num, den), "token long, a0 long, a1 long, b0 long, b1 long, place long"))

    def named(df: DataFrame, side: str) -> DataFrame:
        to = classes.table.where("node is not null").select(
            F.col("k0").alias(f"{side}0"), F.col("n_shingles").alias(f"{side}1"), F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("outline").alias(f"outline_{side}")
        )
        return df.join(to, [f"{side}0", f"{side}1"]).drop(f"{side}0", f"{side}1")

    pairs = found.where("token is null").groupBy("a0", "a1", "b0", "b1").agg(F.sum("place").alias("lists"))
    pairs = named(named(pairs.where(F.col("lists") >= SHARED).drop("lists"), "a"), "b")
    pairs = cut(pairs.mapInArrow(_rule_out(num, den), "a long, b long").where("a <> b").distinct())
    links = _verified(spark, docs, pairs, classes, width, num, den)

    lists, listed = found.where("token is not null").select("token", "a0", "a1", "place"), None
    if lists.limit(1).count():
        sized = lists.join(classes.table.select(F.col("k0").alias("a0"), F.col("n_shingles").alias("a1"), "node", F.col("n_shingles").alias("n"), "outline"), ["a0", "a1"]).where("node is not null")
        label = components(links)
        lists = cut(sized.join(label, "node", "left").select("token", "node", "n", "place", "outline", F.coalesce("component", "node").alias("label")))
        listed = cut(lists.groupBy("node").agg(F.max("n").alias("n")))
        pieces = list(_pieces(lists))
        rest = None
        if pieces:
            dealt = functools.reduce(DataFrame.union, pieces).groupBy("token", "i", "j").applyInPandas(_cross(num, den), "a long, b long")
            rest = cut(dealt.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if rest is not None and rest.limit(1).count():
            more = _verified(spark, docs, rest, classes, width, num, den)
            label = merge_components(label, more)
            links = cut(links.union(more))
    else:
        label = components(links)
    members = own.join(classes.table.drop("outline"), ["n_shingles", "k0", "k1"], "left")
    return Found(members, links, label, listed, classes)


def duplicate_groups(
    spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """``(doc_id, n_shingles, k0, k1, component_id, keeper)``: groups without their links, which cost a pass of their own.

    k0 and k1 are the fingerprint of the set. Rows with ``keeper`` are those of the first class of a group under its
    smallest doc_id: several only if rows repeat both. Rows with empty sets are groups of their own.
    """
    found = similarity_classes(spark, docs, width, similarity)
    out = found.members.join(found.classes.first_of(found.label), "node", "left").withColumn("component_id", F.coalesce("component", "first", "doc_id"))
    own_class = F.coalesce((F.col("k0") == F.col("r0")) & (F.col("k1") == F.col("r1")), F.lit(True))
    keeper = (F.col("doc_id") == F.col("component_id")) & own_class
    return out.select("doc_id", "n_shingles", "k0", "k1", "component_id", F.coalesce(keeper, F.lit(True)).alias("keeper"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the document itself included;
    ``n_links`` counts the verified links of the document's class to other classes, all of them. A row whose
    doc_id is repeated with another text has the component and the links of its own text.
    """
    num, den = (x // math.gcd(*similarity) for x in similarity)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = similarity_classes(spark, docs, width, similarity)
    degree = _degrees(spark, docs, found, width, num, den)
    label = found.classes.first_of(found.label).join(degree, "node", "left")
    return found.members.join(label, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _keyed(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = [_classes(sets).view(np.int64) for _, _, sets in _sets(batch, width)]
            if keys:
                own = np.concatenate(keys)
                names = [*batch.schema.names, "__k0", "__k1"]
                yield pa.record_batch([*batch.columns, pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], names=names)

    return lean(run)


def with_class(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs``, whose ``text`` is a string, with the fingerprint of the text's shingle set as ``__k0`` and ``__k1``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__k0", T.LongType()), T.StructField("__k1", T.LongType())])
    return docs.mapInArrow(_keyed(width), schema)
