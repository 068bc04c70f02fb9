import pytest
from pyspark.sql import functions as F

from millrace.operators import streams as S


@pytest.fixture(scope="module")
def events(spark):
    rows = [("k", i, t, n, float(i)) for i, (t, n) in enumerate([(0, "x"), (1, "y"), (5, "x"), (6, "x"), (20, "y"), (21, "z"), (40, "x")])]
    df = spark.createDataFrame(rows, "key string, seq long, t long, node string, value double")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_overflow(events):
    assert seqs(S.overflow(events, ["key"], ["seq"], 2)) == [5, 6]
    assert seqs(S.overflow(events, ["key"], ["seq"], 2, "newest")) == [0, 1]
    assert S.dropped_count(events, ["key"], 2).first().dropped == 5
    with pytest.raises(Exception, match="buffer is full"):
        S.overflow(events, ["key"], ["seq"], 2, "error").collect()
    with pytest.raises(ValueError):
        S.overflow(events, ["key"], ["seq"], 2, "sideways")


def test_rate_limits(events):
    assert seqs(S.debounce(events, ["key"], ["seq"], "ts", 4)) == [1, 3, 5]
    assert seqs(S.debounce(events, ["key"], ["seq"], "ts", 4, flush_last=True)) == [1, 3, 5, 6]
    assert seqs(S.throttle(events, ["key"], ["seq"], "ts", 5)) == [0, 2, 4, 6]


def test_buffers(events):
    full = S.buffer_batches(events, ["key"], ["seq"], 3)
    assert [(r.seq, r.batch) for r in full.orderBy("seq").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)]
    assert S.buffer_batches(events, ["key"], ["seq"], 3, keep_tail=True).count() == 7
    last = {(r.batch, r.node): r.value for r in S.last_per_node(full, ["key"], "node", "value", ["seq"]).collect()}
    assert last == {(0, "x"): 2.0, (0, "y"): 1.0, (1, "x"): 3.0, (1, "y"): 4.0, (1, "z"): 5.0}
    timed = S.buffer_time(events, ["key"], ["seq"], "ts", 5, 10)
    assert [(r.seq, r.batch) for r in timed.orderBy("seq").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2)]


def test_joining(events):
    x, y = events.where("node = 'x'"), events.where("node = 'y'")
    assert S.merge(x, y).count() == 6
    with pytest.raises(ValueError):
        S.merge(x)
    latest = S.combine_latest(events, ["key"], ["seq"], "node", "value", ["x", "y"]).orderBy("seq").collect()
    assert [(r.seq, r.latest_x, r.latest_y) for r in latest] == [(1, 0.0, 1.0), (2, 2.0, 1.0), (3, 3.0, 1.0), (4, 3.0, 4.0), (6, 6.0, 4.0)]


def test_queue(spark):
    asked = spark.createDataFrame(
        [("y", 3, 1, 0.0, 5.0), ("x", 2, 2, 0.0, 0.0), ("x", 1, 3, 0.0, 9.0), ("z", 0, 4, 50.0, 0.0)], "node string, priority int, seq long, trigger_time double, delay double"
    )
    tasks = S.coalesce_tasks(asked, "node", "priority", "seq", "delay")
    assert {(r.node, r.priority, r.delay) for r in tasks.collect()} == {("y", 3, 5.0), ("x", 1, 0.0), ("z", 0, 0.0)}
    assert [r.node for r in S.tick(tasks, 10.0).collect()] == ["x", "y"]
    assert [r.node for r in S.tick(tasks, 10.0, 1).collect()] == ["x"]
    assert S.cancel(tasks, spark.createDataFrame([("x",)], "node string"), "node").count() == 2
    stats = S.group_stats(spark.createDataFrame([("g", "active"), ("g", "paused"), ("g", "active")], "grp string, state string")).first()
    assert (stats.active, stats.paused, stats.disposed) == (2, 1, 0)
