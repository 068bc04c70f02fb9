"""Blueprints and rate limits kept live with Structured Streaming.

``LiveReplay`` runs each micro-batch through the same window plan as a historical replay, after one seed row a
source with what was known before. The state (last source values and generations of each key) is appended
to a folder for each batch and read back as the latest row of each key, so a batch touches only its own
keys' state, and a batch that is repeated after a failure starts from the same state and writes over the same folders.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from millrace.graph.blueprint import Blueprint
from millrace.plans.history import replay
from millrace.sources.claims import file_system


class LiveReplay:
    """A blueprint over a stream of changes ``key, seq, input, value``; changed nodes land in ``path/changes``."""

    def __init__(self, graph: Blueprint, path: str, compact_every: int = 50) -> None:
        self.graph, self.path, self.compact_every = graph, path, compact_every

    def _numbers(self, spark: SparkSession) -> list[int]:
        """The batches whose state is there, by one look at the folder."""
        fs, at = file_system(spark, f"{self.path}/state")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def _state(self, spark: SparkSession, before: int) -> DataFrame | None:
        """The latest state of each key from batches before this one."""
        # a compacted state stands for all batches up to its own
        whole = before // self.compact_every * self.compact_every - 1
        paths = [f"{self.path}/state/{b}" for b in self._numbers(spark) if max(whole, 0) <= b < before]
        if not paths:
            return None
        df = spark.read.parquet(*paths)
        return df.groupBy("key").agg(F.max_by(F.struct(*[c for c in df.columns if c != "key"]), "batch").alias("s")).select("key", "s.*")

    def process(self, batch: DataFrame, number: int) -> None:
        spark, g = batch.sparkSession, self.graph
        log = batch.select("key", F.lit(1).alias("phase"), "seq", "input", F.col("value").cast("double").alias("value"))
        state = self._state(spark, number)
        gens = [f"{n}__generation" for n in g.names]
        touched = state.join(log.select("key").distinct(), "key", "left_semi") if state is not None else None
        if touched is not None:
            known = F.filter(F.array(*[F.when(F.col(f"{s}__known"), F.struct(F.lit(s).alias("input"), F.col(s).alias("value"))) for s in g.sources]), lambda e: e.isNotNull())
            seeds = touched.select("key", F.posexplode(known).alias("pos", "e")).select("key", F.lit(0).alias("phase"), F.col("pos").cast("long").alias("seq"), "e.*")
            log = log.unionByName(seeds)
        h = replay(log, g, ["key"], ["phase", "seq"])
        frame = h.frame
        if touched is not None:
            frame = frame.join(touched.select("key", *[F.col(c).alias(f"{c}__prior") for c in gens]), "key", "left")
        whole = Window.partitionBy("key")
        for c in gens:
            seeded = F.coalesce(F.max(F.when(F.col("phase") == 0, F.col(c))).over(whole), F.lit(0))
            prior = F.coalesce(F.col(f"{c}__prior"), F.lit(0)) if touched is not None else F.lit(0)
            frame = frame.withColumn(c, F.col(c) - seeded + prior)
        frame = frame.where("phase = 1").persist()
        each = [
            F.when(F.col(f"{n}__changed"), F.struct(F.lit(n).alias("node_id"), F.col(n).cast("double").alias("value"), F.col(f"{n}__generation").alias("generation")))
            for n in g.derived
        ]
        changes = frame.select("key", "seq", F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e")).select("key", "seq", "e.*")
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/{number}")

        known_now = {s: F.max(F.when(F.col("input") == s, True)).alias(f"{s}__new") for s in g.sources}
        heard = batch.groupBy("key").agg(*known_now.values())
        last = frame.groupBy("key").agg(F.max_by(F.struct(*g.sources, *gens), F.col("seq")).alias("s")).select("key", "s.*").join(heard, "key")
        if touched is not None:
            last = last.join(touched.select("key", *[F.col(f"{s}__known").alias(f"{s}__was") for s in g.sources]), "key", "left")
        known = [F.coalesce(F.col(f"{s}__new"), F.col(f"{s}__was") if touched is not None else F.lit(False), F.lit(False)).alias(f"{s}__known") for s in g.sources]
        new = last.select("key", *[F.col(s).cast("double").alias(s) for s in g.sources], *gens, *known, F.lit(number).cast("long").alias("batch"))
        if (number + 1) % self.compact_every == 0 and state is not None:
            new = new.unionByName(state.join(new.select("key"), "key", "left_anti").select(*new.columns))
        new.write.mode("overwrite").parquet(f"{self.path}/state/{number}")
        frame.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def changes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/changes/*")


def live_throttle(events: DataFrame, keys: Sequence[str], order: str, ts: str, interval_seconds: float) -> DataFrame:
    """``keys, order`` of the events that a greedy rate limit lets pass; the state of a key is the time of its last.

    Within a micro-batch a key's events are taken in order, in chunks as Arrow delivers them.
    """
    interval = int(interval_seconds * 1_000_000)
    keys = list(keys)
    slim = events.select(*keys, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def limit(key: tuple, frames: Iterable, state: GroupState) -> Iterable:
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["__t", order])
        ids, times, kept = rows[order].to_numpy(), rows["__t"].to_numpy(), []
        at = 0 if last is None else int(times.searchsorted(last + interval))
        while at < len(times):  # leap from emission to emission
            last = int(times[at])
            kept.append(ids[at])
            at = max(at + 1, int(times.searchsorted(last + interval)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({**{k: [v] * len(kept) for k, v in zip(keys, key, strict=True)}, order: kept})

    out = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order])
    return slim.groupBy(*keys).applyInPandasWithState(limit, out, "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_totals(events: DataFrame, ts: str, node: str, value: str, window: str, lateness: str) -> DataFrame:
    """Totals of each node by event-time window; events later than ``lateness`` no longer count."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    totals = timed.groupBy(F.window("__ts", window).alias("w"), node).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return totals.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), node, "total", "n")
