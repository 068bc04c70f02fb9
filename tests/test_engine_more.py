"""What the queries of the engine do not show: refusals, edges, and cases that no table has."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.lineage import cut, cut_counted, cut_once, shared_folder
from millrace.graph import Blueprint
from millrace.operators import streams as S
from millrace.operators import values as V
from millrace.operators.windows import Trailing, restarts
from millrace.plans import federation as D
from millrace.plans import graphs as G
from millrace.plans import optimize as O
from millrace.plans.engine import Workbench
from millrace.plans.history import Differences, diff_kinds
from millrace.sources import journal as J
from millrace.sources.claims import claim
from millrace.sources.kv import LruCache, TableStore


def test_cut(spark):
    df = spark.range(10)
    a, n = cut_counted(df.where("id > 3"))
    assert n == a.count() == 6 and cut_once(a) is a and cut_once(df) is not df
    assert cut_counted(df, F.col("id") % 2 == 0)[1] == 5 and cut_counted(df.where("id < 0"))[1] == 0
    assert shared_folder(spark) and cut(df).count() == 10


def test_aggregate_by_name():
    for op, kw in (("median", {}), ("custom", {}), ("weighted", {})):
        with pytest.raises(ValueError):
            V.aggregate(op, ["a"], **kw)
    with pytest.raises(ValueError):
        V.aggregate("sum", [])


def test_aggregate_custom_and_weighted(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    custom = V.aggregate("custom", ["a", "b"], lambda c: c[1] - c[0])
    weighted = V.aggregate("weighted", ["a", "b"], weights=[1, 3])
    cols = {"a": F.col("a"), "b": F.col("b")}
    assert df.select(custom(cols).alias("x"), weighted(cols).alias("y")).first()[:] == (2.0, 2.5)


def throttled(rows, interval):
    out, last = [], {}
    for k, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2])):
        if t is not None and (k not in last or t - last[k] >= interval):
            last[k] = t
            out.append((k, i))
    return sorted(out, key=str)


@pytest.mark.parametrize("ordered", [True, False])
def test_throttle_over_batches(spark, ordered):
    """A key's events go on from batch to batch; times need not follow the order; null keys are a key."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000) if rng.random() < 0.95 else None, i) for i in range(900)]
    if ordered:
        rows = [(k, None if t is None else i, i) for k, t, i in rows]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    df = spark.createDataFrame(rows, "k string, t long, i long").select("k", "i", F.timestamp_seconds("t").alias("ts"))
    got = S.throttle(df, ["k"], ["i"], "ts", 25)
    assert got.columns == ["k", "i"]
    got = sorted(((r.k, r.i) for r in got.collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == throttled(rows, 25)
    assert S.throttle(df.limit(0), ["k"], ["i"], "ts", 25).count() == 0


def buffered(rows, limit, size):
    out, open_, number = [], {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[2])):
        b = open_.setdefault(k, [])
        b.append((t, i))
        if len(b) >= size or t - b[0][0] >= limit:
            n = number[k] = number.get(k, -1) + 1
            out += [(k, j, n) for _, j in b]
            open_[k] = []
    return sorted(out)


@pytest.mark.parametrize("ordered", [True, False])
def test_buffer_time_over_batches(spark, ordered):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), (i * 3 if ordered else 0) + rng.randrange(3 if ordered else 500), i) for i in range(700)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    df = spark.createDataFrame(rows, "k string, t long, i long").select("k", "i", F.timestamp_seconds("t").alias("ts"))
    got = sorted((r.k, r.i, r.batch) for r in S.buffer_time(df, ["k"], ["i"], "ts", 40, 9).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == buffered(rows, 40, 9)


def test_sync_conflicts_against_pairs(spark):
    import random

    rng = random.Random(5)
    writes = [(rng.randrange(3), rng.randrange(100), rng.choice("xy"), rng.choice("mn")) for _ in range(150)]
    syncs = list({(rng.randrange(3), s, *rng.choice([("x", "y"), ("y", "x"), ("z", "y")]), n) for s in (rng.randrange(100) for _ in range(40)) for n in "mn"})
    want = []
    for k, s, a, b, n in syncs:
        since = max((o[1] for o in syncs if o[0] == k and o[2:4] == (a, b) and o[1] < s), default=-1)
        hits = sum(w[0] == k and w[2] == b and w[3] == n and since < w[1] < s for w in writes)
        if hits:
            want.append((k, s, a, b, n, hits))
    m = spark.createDataFrame(writes, "k int, seq int, graph string, node string")
    d = spark.createDataFrame(syncs, "k int, seq int, source string, target string, node string")
    got = D.sync_conflicts(m, d, ["k"])
    assert sorted((r.k, r.seq, r.source, r.target, r.node, r.writes) for r in got.collect()) == sorted(want)


def test_clocks(spark):
    df = spark.createDataFrame([("k", {"a": 1, "b": 5}), ("k", {"a": 3}), ("j", {})], "key string, clock map<string,bigint>")
    assert {r.key: r.clock for r in D.merged_clocks(df, ["key"]).collect()} == {"k": {"a": 3, "b": 5}}
    assert df.select(D.incremented(F.col("clock"), F.lit("b")).alias("c")).collect()[1].c == {"a": 3, "b": 1}


def test_windows(spark):
    df = spark.createDataFrame([("a", i, i * 10, i == 3) for i in range(6)], "k string, i int, v int, clear boolean")
    rows = restarts(df, ["k"], ["i"], F.col("clear"), "since")
    got = rows.select("i", Trailing(["k", "since"], ["i"], 3).values(F.col("v")).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [[0], [0, 10], [0, 10, 20], [30], [30, 40], [30, 40, 50]]
    assert Trailing(["k"], ["i"], 2).last_buffer(df, F.col("v")).first()[:] == ("a", [40, 50])


def test_workbench_checkpoint(spark):
    g = Blueprint()
    g.source("s")
    g.derive("n", lambda t: t["s"].groupBy().agg(F.count("*").alias("c")), ["s"])
    w = Workbench(g)
    assert w.memo("n") is None and w.seen("n") == {} and w.states() == {"s": "DIRTY", "n": "DIRTY"}
    w.set("s", spark.range(3))
    w.demand("n")
    mark = w.checkpoint()
    for k in (4, 5):
        w.set("s", spark.range(k))
        assert w.demand("n")["n"].first().c == k
        mark.restore()
        assert w.memo("n").first().c == 3 and w.generation("s") == 1 and w.states()["n"] == "CLEAN"


def test_liveness_and_annotations():
    g = Blueprint()
    g.source("a")
    g.derive("b", lambda c: c["a"], ["a"])
    g.derive("c", lambda c: c["a"], ["a"])
    assert O.liveness(g, ["b"]) == {"a": True, "b": True, "c": False}
    model = O.CostModel(g)
    for bad in (("zz", 1, 1), ("b", -1, None), ("b", None, -1)):
        with pytest.raises(ValueError):
            model.annotate(*bad)
    model.annotate("b", memory=4096, io=7)
    assert model.of("b").bytes == 4096 and model.of("b").is_io_bound


def test_differences(spark):
    schema = "k int, node_id string, value double, generation long, state string"
    a = spark.createDataFrame([(1, "x", 1.0, 1, "CLEAN"), (1, "y", 1.0, 1, "CLEAN")], schema)
    b = spark.createDataFrame([(1, "x", 1.0, 1, "DIRTY"), (1, "z", 1.0, 1, "CLEAN")], schema)
    d = Differences(diff_kinds(a, b, ["k"]))
    assert {(r.node_id, r.change) for r in d.rows.collect()} == {("x", "STATE_CHANGED"), ("y", "NODE_REMOVED"), ("z", "NODE_ADDED")}
    assert d.count() == 3 and d.any() and not Differences(diff_kinds(a, a, ["k"])).any()


def test_longest_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("z", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert {r.node_id: r.depth for r in G.longest_depths(edges, seeds).collect()} == {"b": 1, "c": 2, "d": 3}


def test_claims_and_journal(spark, tmp_path):
    assert [claim(spark, str(tmp_path / "c")) for _ in range(3)] == [1, 2, 3]
    j = J.Journal(spark, str(tmp_path / "j"))
    assert j.log().count() == 0
    a = j.log_put("k", "1", txn="t")
    b = j.log_put("k", "2", old_value="1", txn="t")
    j.log_delete("k", old_value="2")
    assert a < b and [r.seq for r in j.rollback_transaction("t").collect()] == [b, a]
    j.commit_transaction("t")  # what is rolled back stays so
    assert {r.state for r in j.log().where("txn = 't'").collect()} == {J.ROLLED_BACK}
    assert j.log().where(J.is_valid()).count() == 3 and j.compact() == 2 and j.compact() == 0
    j.vacuum()
    assert [(r.op, r.state) for r in j.log().collect()] == [("delete", J.PENDING)]


def test_stores_share_a_contract(spark, tmp_path):
    for store in (TableStore(spark, str(tmp_path / "s")), LruCache(10)):
        store.put_many({"a": 1, "b": 2})
        store.put("a", 3)
        assert store.get_many(["a", "zz"]) == {"a": 3, "zz": None} and store.exists("b") and store.size() == 2 and sorted(store.keys()) == ["a", "b"]
        held = store.snapshot()
        held = held if isinstance(held, dict) else cut(held)
        assert store.delete("b") and not store.delete("b") and store.clear() == 1
        store.restore(held)
        assert store.get("b") == 2 and store.stats().hits == 2
    two = TableStore(spark, str(tmp_path / "s"))
    two.put("a", 9, generation=4)
    assert two.content().where("key = 'a'").first().generation == 4


def test_corrupt_store_is_no_empty_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "s"))
    s.put("a", 1)
    for f in (tmp_path / "s" / "ops").glob("*.parquet"):
        f.write_bytes(b"not parquet")
    for f in (tmp_path / "s" / "ops").glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception):  # noqa: B017
        s.get("a")


def test_segments():
    batch = pa.record_batch([pa.array(["a", "a", None, None, "b"]), pa.array([1, 1, 1, 2, 2])], names=["x", "y"])
    start, stop, names, same = S._segments(batch, ["x", "y"], ("a", 1))
    assert (start, stop, same) == ([0, 2, 3, 4], [2, 3, 4, 5], True) and names == [("a", 1), (None, 1), (None, 2), ("b", 2)]
