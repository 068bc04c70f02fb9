"""Transactions and batches over an append-only log. Rolled back changes are rows that are left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import differs
from millrace.graph.blueprint import Blueprint
from millrace.plans.evaluate import evaluate


def collapse(log: DataFrame, txn: str, name: str, value: str, order: str) -> DataFrame:
    """The last value that each transaction sets for each source: a commit propagates once."""
    last = F.max_by(F.struct(F.col(value)), F.col(order))[value]
    return log.groupBy(txn, name).agg(last.alias(value))


def without_failed(log: DataFrame, txn: str, bad: str) -> DataFrame:
    """The rows of transactions without any bad row. Rows outside transactions (null) stand for themselves."""
    failed = log.where(F.col(bad) & F.col(txn).isNotNull()).select(txn).distinct()
    return log.join(failed, txn, "left_anti").where(F.col(txn).isNotNull() | ~F.coalesce(F.col(bad), F.lit(False)))


def skipped(changes: DataFrame, batch: str, name: str, value: str) -> DataFrame:
    """``skipped``: the batch sets what the source already has."""
    w = Window.partitionBy(name).orderBy(batch)
    known = F.lag(F.lit(True)).over(w).isNotNull()
    return changes.withColumn("skipped", known & ~differs(F.col(value), F.lag(value).over(w)))


def validated(changes: DataFrame, batch: str, ok: Column) -> DataFrame:
    """``accepted``: every change of the batch passes, else none of it is applied."""
    w = Window.partitionBy(batch)
    return changes.withColumn("accepted", F.bool_and(F.coalesce(ok, F.lit(False))).over(w))


def until_failure(batches: DataFrame, keys: Sequence[str], order: str, failed: str) -> DataFrame:
    """Batches in order up to the first that fails, which is included."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.col(failed), F.lit(False)).cast("int")
    return batches.withColumn("__before", F.sum(own).over(w) - own).where("__before = 0").drop("__before")


def dry_run(state: DataFrame, graph: Blueprint, changes: Mapping[str, Column], outputs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """What the outputs would be after ``changes``; nothing is kept."""
    return evaluate(state.select(*keys, *graph.sources), graph, outputs, bind=changes).select(*keys, *outputs)
