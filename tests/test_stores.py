import pytest
from pyspark.sql import functions as F

from millrace.sources import journal as J
from millrace.sources.kv import LruCache, TableStore, latest, lru_resident

SCHEMA = "seq long, op string, key string, value string, old_value string, txn string, bad boolean"


def journal(spark, rows):
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("state", F.lit(J.PENDING))
    return df.withColumn("checksum", F.when(F.col("bad"), "broken").otherwise(J.checksum()))


def content(df):
    return {r.key: r.value for r in df.collect()}


def put(key, value, txn=None, bad=False, old=None):
    return ("put", key, value, old, txn, bad)


def test_transactions_are_all_or_nothing(spark):
    log = journal(spark, [put("alpha", "1", "t"), put("beta", "2", "t", True)])
    assert content(J.recover(log)) == {} and J.recoverable(log).where("recovered").count() == 0
    log = journal(spark, [put("a", "1", "t"), put("b", "2", "t"), put("c", "3", "t")])
    assert content(J.recover(log, F.col("key") != "b")) == {}
    log = journal(spark, [put("keep_1", "1", "ok"), put("drop_1", "2", "no", True), put("keep_2", "3", "ok"), put("drop_2", "4", "no")])
    assert content(J.recover(log)) == {"keep_1": "1", "keep_2": "3"}
    log = journal(spark, [put("a", "1"), put("b", "2", bad=True), put("c", "3")])
    assert content(J.recover(log)) == {"a": "1", "c": "3"}


def test_states(spark):
    log = journal(spark, [put("a", "1", "t"), put("a", "2", "t", old="1"), ("delete", "a", None, "2", "u", False), ("clear", "", None, None, None, False)])
    done = J.roll_back(J.commit_transaction(log, "t"), "u")
    assert [r.state for r in done.orderBy("seq").collect()] == ["committed", "committed", "rolled_back", "pending"]
    assert J.pending(done).count() == 1 and J.compact(done).count() == 1
    assert [r.seq for r in J.undo_entries(done, 1).collect()] == [2] and J.undo_entries(done, 0).count() == 0
    assert J.pending(J.commit_up_to(log, 3)).count() == 1
    assert [(r.op, r.value) for r in J.compensation(log).orderBy("seq").collect()] == [("delete", None), ("put", "1"), ("put", "2"), ("clear", None)]


def test_clear_and_delete(spark):
    rows = [(1, "put", "a", "1"), (2, "clear", "", None), (3, "put", "b", "2"), (4, "put", "c", "3"), (5, "delete", "c", None)]
    assert content(latest(spark.createDataFrame(rows, "seq long, op string, key string, value string"))) == {"b": "2"}


def test_table_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "kv"))
    assert s.size() == 0 and s.get("a") is None
    values = {"i": 1, "f": 1.5, "s": "text", "l": [1, 2], "d": {"k": None}, "n": None}
    s.put_many(values)
    assert s.get_many(values) == values and s.exists("n") and not s.exists("zz")
    s.put("i", 2)
    s.delete("s")
    assert s.get("i") == 2 and s.keys() == ["d", "f", "i", "l", "n"]
    again = TableStore(spark, str(tmp_path / "kv"))
    assert again.get("i") == 2
    small = again.vacuum(str(tmp_path / "small"))
    assert small.keys() == again.keys() and small.snapshot().count() == 5
    small.clear()
    assert small.size() == 0


def test_lru(spark):
    c = LruCache(5)
    for i in range(5):
        c.put(f"key_{i}", i)
    assert c.get("key_0") == 0
    c.put("key_5", 5)
    assert "key_1" not in c and "key_0" in c and c.evicted == 1 and c.utilization == 1.0
    assert c.peek("key_2") == 2 and c.keys()[0] == "key_2" and c.get("none") is None and c.hit_rate == 0.5
    assert c.delete("key_2") and not c.delete("key_2") and c.clear() == 4 and len(c) == 0
    with pytest.raises(ValueError):
        LruCache(0)
    log = spark.createDataFrame([(i, f"key_{i % 6}") for i in (0, 1, 2, 3, 4, 6, 5)], "seq long, key string").withColumn("seq", F.monotonically_increasing_id())
    assert {r.key for r in lru_resident(log, 5).collect()} == {"key_0", "key_2", "key_3", "key_4", "key_5"}
