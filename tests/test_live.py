import random

from pyspark.sql import functions as F

from millrace.graph import Blueprint
from millrace.operators.streams import throttle
from millrace.plans.history import replay
from millrace.streaming.live import LiveReplay, live_throttle, windowed_totals

LOG = "key string, seq long, input string, value double"


def graph():
    g = Blueprint()
    g.source("x")
    g.source("y")
    g.derive("total", lambda c: c["x"] + c["y"], ["x", "y"])
    g.derive("coarse", lambda c: F.floor(c["total"] / 10), ["total"])
    return g


def write_parts(spark, rows, schema, path, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)


def test_live_equals_replay(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(3)}", i, rng.choice("xy"), float(rng.choice([1, 2, 15, 30]))) for i in range(60)]
    write_parts(spark, rows, LOG, str(tmp_path / "in"), 4)
    live = LiveReplay(graph(), str(tmp_path / "out"), compact_every=2)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = live.start(stream, str(tmp_path / "check"), availableNow=True)
    assert q.awaitTermination(120)
    want = replay(spark.createDataFrame(rows, LOG), graph(), ["key"], ["seq"]).recomputed()
    f = lambda df: sorted((r.key, r.seq, r.node_id, r.value, r.generation) for r in df.collect())
    assert f(live.changes(spark)) == f(want)


def test_live_throttle_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(2)}", i, 10 * i + rng.randrange(10)) for i in range(40)]
    schema = "key string, seq long, t long"
    write_parts(spark, rows, schema, str(tmp_path / "in"), 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    out = live_throttle(stream, ["key"], "seq", "ts", 45).writeStream.format("memory").queryName("throttled").outputMode("append")
    assert out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    batch = throttle(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")), ["key"], ["seq"], "ts", 45)
    f = lambda df: sorted((r.key, r.seq) for r in df.collect())
    assert f(spark.table("throttled")) == f(batch)


def test_windowed_totals(spark, tmp_path):
    schema = "seq long, t long, node string, value long"
    spark.createDataFrame([(1, 0, "x", 1), (2, 5, "x", 2), (3, 70, "x", 4), (4, 300, "x", 8)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    q = windowed_totals(stream, "ts", "node", "value", "1 minute", "10 seconds").writeStream.format("memory").queryName("totals").outputMode("append")
    assert q.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.total for r in spark.table("totals").collect()) == [3, 4]
