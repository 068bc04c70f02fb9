"""Queries that run as streams until their input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cents
from millrace.functions.lineage import shared_folder
from millrace.plans.catalogue import query
from millrace.plans.q_history import PARENTS, _sql, _union, engagement
from millrace.sources.tables import table
from millrace.streaming.live import LiveReplay, live_throttle


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # a pattern, because a stream does not take a single file by its plain path
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query(_sql() + _union([f"SELECT user_id, event_id, '{n}' AS node_id, CAST(\"{n}\" AS DOUBLE) AS value, {n}_generation AS generation FROM h WHERE {n}_changed" for n in PARENTS]))
def live_replay(spark, sf_dir):
    """The replay of ``history_propagate`` as a stream. Events are in the order of their ids."""
    at = _folder(spark, "live-replay")
    live = LiveReplay(engagement(), f"{at}/out")
    changes = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("input"), cents(F.col("value")).alias("value"))
    live.start(changes, f"{at}/checkpoint", availableNow=True).awaitTermination()
    return live.changes(spark).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "node_id", "value", "generation")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, ts, event_id, n FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, ts, event_id, n FROM (
    SELECT e.user_id, e.ts, e.event_id, e.n, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS k
    FROM r JOIN e ON e.user_id = r.user_id AND e.n > r.n AND epoch_us(e.ts) - epoch_us(r.ts) >= 43200000000) WHERE k = 1)
SELECT event_id, user_id FROM r"""
)
def live_rate_limit(spark, sf_dir):
    """``stream_throttle`` with its state kept by the stream."""
    at = _folder(spark, "live-throttle")
    limited = live_throttle(_stream(spark, sf_dir), ["user_id"], "event_id", "ts", 12 * 3600)
    q = limited.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id")
