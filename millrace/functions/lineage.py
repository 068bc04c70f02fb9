"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_done: weakref.WeakSet[DataFrame] = weakref.WeakSet()
_rows: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()

#: Rows that one task takes on average where rows are dealt out by a key; more rows make more tasks, not larger ones.
SHARE = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session that driver and executors share: the checkpoint folder, or ``spark.checkpoint.dir``.

    Only where both are one process, as in tests, may none be named; then it is a temporary one.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder, so that an iteration's plan stays short."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _done.add(out)
    return out


def cut_once(df: DataFrame) -> DataFrame:
    """``cut``, unless the frame is one that it gave."""
    return df if df in _done else cut(df)


def cut_counted(df: DataFrame, test: Column | None = None) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows (that pass the test), which is observed while they are written: one job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.lit(True) if test is None else test).alias("n")))
    n = seen.get["n"]
    if test is None:
        _rows[out] = n
    return out, n


def rows(df: DataFrame) -> int:
    """Its number of rows, which a frame that ``cut_counted`` gave knows."""
    return _rows[df] if df in _rows else df.count()


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows dealt out by the keys, for some ``n`` rows: a task's share, and so its memory, stays the same in larger tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(n // SHARE + 1, min(cores, n // 10_000 + 1)), *keys)
