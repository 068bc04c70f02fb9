"""Shared pieces of the corpus operators: session preparation, cut lineage, byte-level kernels."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch: long documents must not add up to more than a worker holds.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_U = np.uint64
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make the workers able to import this package, bound Arrow batches, and name the checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where driver and executors are one process, as in
    tests, may it be unset, and a folder of our own is named. The bounds of Arrow batches are lowered for the session
    if they are higher, never raised.
    """
    sc = spark.sparkContext
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    files = sorted([root / "__init__.py", *(root / "llm").glob("*.py"), *(root / "llm").glob("*.npz")])
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = os.path.join(tempfile.mkdtemp(prefix="millrace-code-"), f"millrace_llm_{digest}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in files:
            z.write(p, f"millrace/{p.relative_to(root)}")
    sc.addPyFile(target)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder; their lineage ends there."""
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder, on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key128(*cols: Column) -> Column:
    """A 128-bit fingerprint of the columns as a struct of two independent 64-bit hashes."""
    return F.struct(F.xxhash64(*cols).alias("k0"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("k1"))


def doc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id written as text, modulo n; null where doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bit_table(spark: SparkSession, places: DataFrame, bits: int):
    """``places(at)`` as a broadcast table of ``2**bits`` bits, put together in 64-bit words by an aggregate."""
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    rows = places.select(F.shiftright("at", 6).alias("w"), word.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).collect()
    table = np.zeros(1 << (bits - 6), _U)
    for r in rows:
        table[r["w"]] = r["bits"] & ((1 << 64) - 1)
    return spark.sparkContext.broadcast(np.packbits(np.unpackbits(table.view(np.uint8), bitorder="little")).tobytes())


def table_bits(rows: int) -> int:
    """Address bits of a bit table for so many rows: 64 places a row, but between 2^20 and 2^26 in all."""
    return min(max(20, (64 * rows).bit_length()), 26)


def release() -> None:
    """Give memory that is free within this worker back to the system: workers live on, beside the next task's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with what it held given back at its end."""

    def lean_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return lean_run


# --- byte kernels ----------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    step = base % (1 << 64)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(step)
        done += more
        step = step * step % (1 << 64)
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables["r"] = _powers(_R, 2 * _PIECE + 1)
        _tables["inv"] = _powers(_R_INV, 2 * _PIECE + 1)
    return _tables["r"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def narrow(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, in six bytes."""
    return np.ascontiguousarray((h >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets, is-null) without copying; nulls are empty."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    null = np.zeros(n, bool) if not column.null_count else np.asarray(column.is_null())
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets, null


def slices(offsets: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes together; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of adjacent texts, and for each text the index of its first word.

    ``data`` holds the texts one after the other, ``offsets`` their bounds. Words are lower-cased
    in A-Z and never cross texts. Long inputs go through in pieces, so that tables stay small.
    """
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    r, inv = _power_tables()
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + 2 * _PIECE, "right"))
        if j == i:  # one word longer than a piece
            total, scale = 0, 1
            for a in range(int(base), int(ends[i]), _PIECE):
                b = min(a + _PIECE, int(ends[i]))
                part = int((( _LOWER[data[a:b]].astype(_U) + _U(1)) * r[: b - a]).sum(dtype=_U))
                total = (total + part * scale) % (1 << 64)
                scale = scale * pow(_R, b - a, 1 << 64) % (1 << 64)
            out[i] = total
            i += 1
            continue
        stop = ends[j - 1]
        run = np.zeros(stop - base + 1, _U)
        np.cumsum((_LOWER[data[base:stop]].astype(_U) + _U(1)) * r[: stop - base], out=run[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (run[e] - run[s]) * inv[s]
        i = j
    return mix(out + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)), first


_SHINGLE = [_U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(32)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words as sorted 64-bit hashes.

    A text with fewer words has its whole word sequence as its only shingle; one without words none.
    """
    words, first = word_hashes(data, offsets)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, _U)
    for k in range(width):
        rolled += words[k : k + n] * _SHINGLE[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            whole = np.array([(b - a) * 0xA0761D6478BD642F % (1 << 64)], _U)
            for k in range(b - a):
                whole += words[a + k : a + k + 1] * _SHINGLE[k]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, _U))
    return out
