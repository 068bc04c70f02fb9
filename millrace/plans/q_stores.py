"""Queries of the stores, the journal and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cents
from millrace.plans.catalogue import query
from millrace.plans.validation import Checks
from millrace.sources import journal as J
from millrace.sources import kv
from millrace.sources.tables import table

_OPS = """ops AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'delete' ELSE 'put' END AS op, CAST(user_id AS VARCHAR) AS key, CAST(round(value * 100) AS BIGINT) AS value FROM events)"""


def _ops(spark, sf_dir):
    op = F.when(F.col("event_type") == "click", "delete").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), cents(F.col("value")).alias("value"))


@query(f"WITH {_OPS}, l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM ops GROUP BY key) SELECT key, value, seq FROM l WHERE op = 'put'")
def kv_latest(spark, sf_dir):
    return kv.latest(_ops(spark, sf_dir))


@query(f"WITH {_OPS}, l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM ops GROUP BY key) SELECT CAST(c_custkey AS VARCHAR) AS key, l.value FROM customer LEFT JOIN (SELECT * FROM l WHERE op = 'put') l ON l.key = CAST(c_custkey AS VARCHAR)")
def kv_get_many(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return kv.get_many(kv.latest(_ops(spark, sf_dir)).drop("seq"), asked)


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS seq FROM events GROUP BY user_id ORDER BY seq DESC LIMIT 50")
def kv_lru_resident(spark, sf_dir):
    return kv.lru_resident(_ops(spark, sf_dir).select("key", "seq"), 50)


@query("SELECT event_type, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (value >= 50) AS DOUBLE) / count(*) END AS rate FROM events GROUP BY event_type")
def kv_hit_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("hits"), F.count_if(F.col("value") < 50).alias("misses"))
    return rows.select("event_type", kv.hit_rate(F.col("hits"), F.col("misses")).alias("rate"))


_J = """j0 AS (SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 'delete' WHEN event_type = 'error' AND user_id % 50 = 0 THEN 'clear' ELSE 'put' END AS op, CAST(user_id AS VARCHAR) AS key,
  CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value, CAST(lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) AS old_value,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id // 4 END AS txn,
  CASE WHEN event_id % 10 < 5 THEN 'committed' WHEN event_id % 10 = 5 THEN 'rolled_back' ELSE 'pending' END AS state FROM events),
j AS (SELECT *, CASE WHEN seq % 17 = 0 THEN 'bad' ELSE substr(md5(concat_ws(':', seq, op, key, value)), 1, 8) END AS checksum FROM j0)"""


def _journal(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    c = cents(F.col("value"))
    op = F.when(F.col("event_type") == "click", "delete").when((F.col("event_type") == "error") & (F.col("user_id") % 50 == 0), "clear").otherwise("put")
    state = F.when(F.col("event_id") % 10 < 5, J.COMMITTED).when(F.col("event_id") % 10 == 5, J.ROLLED_BACK).otherwise(J.PENDING)
    log = e.select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), c.cast("string").alias("value"),
        F.lag(c).over(Window.partitionBy("user_id").orderBy("event_id")).cast("string").alias("old_value"),
        F.when(F.col("event_id") % 3 != 0, F.expr("event_id div 4")).alias("txn"), state.alias("state"),
    )
    return log.withColumn("checksum", F.when(F.col("seq") % 17 == 0, "bad").otherwise(J.checksum()))


@query(f"WITH {_J} SELECT seq, checksum FROM j")
def journal_checksum(spark, sf_dir):
    return _journal(spark, sf_dir).select("seq", "checksum")


@query(f"WITH {_J} SELECT seq, op, key FROM j WHERE state = 'pending'")
def journal_pending(spark, sf_dir):
    return J.pending(_journal(spark, sf_dir)).select("seq", "op", "key")


_R = """r AS (SELECT *, CASE WHEN txn IS NULL THEN seq % 17 <> 0 ELSE bool_and(seq % 17 <> 0) OVER (PARTITION BY txn) END AS recovered FROM j WHERE state = 'pending'),
ok AS (SELECT * FROM r WHERE recovered)"""


@query(f"WITH {_J}, {_R} SELECT seq, recovered FROM r")
def journal_recoverable(spark, sf_dir):
    return J.recoverable(_journal(spark, sf_dir)).select("seq", "recovered")


@query(
    f"WITH {_J}, {_R}, live AS (SELECT * FROM ok WHERE op <> 'clear' AND seq > coalesce((SELECT max(seq) FROM ok WHERE op = 'clear'), -1)), l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM live GROUP BY key) SELECT key, value, seq FROM l WHERE op = 'put'"
)
def journal_recover_atomic(spark, sf_dir):
    return J.recover(_journal(spark, sf_dir))


@query(f"WITH {_J} SELECT seq, key, value FROM j WHERE state = 'committed' ORDER BY seq DESC LIMIT 25")
def journal_undo(spark, sf_dir):
    return J.undo_entries(_journal(spark, sf_dir), 25).select("seq", "key", "value")


@query(f"WITH {_J} SELECT seq, state FROM j WHERE state NOT IN ('committed', 'rolled_back')")
def journal_compact(spark, sf_dir):
    return J.compact(_journal(spark, sf_dir)).select("seq", "state")


@query(f"WITH {_J} SELECT seq, CASE WHEN state = 'pending' AND seq <= 5000 THEN 'committed' ELSE state END AS state FROM j")
def journal_commit_up_to(spark, sf_dir):
    return J.commit_up_to(_journal(spark, sf_dir), 5000).select("seq", "state")


@query(
    f"WITH {_J} SELECT seq, CASE WHEN op IN ('put', 'delete') AND old_value IS NOT NULL THEN 'put' WHEN op = 'put' THEN 'delete' ELSE op END AS op, key, CASE WHEN op IN ('put', 'delete') THEN old_value END AS value FROM j"
)
def journal_compensation(spark, sf_dir):
    return J.compensation(_journal(spark, sf_dir))


@query(f"WITH {_J} SELECT seq, CASE WHEN state = 'pending' AND txn IN (SELECT txn FROM j WHERE txn IS NOT NULL GROUP BY txn ORDER BY txn LIMIT 1 OFFSET 10) THEN 'committed' ELSE state END AS state FROM j")
def journal_commit_transaction(spark, sf_dir):
    """The eleventh transaction is committed."""
    log = _journal(spark, sf_dir)
    return J.commit_transaction(log, _eleventh(log)).select("seq", "state")


def _eleventh(log):
    return log.where("txn is not null").select("txn").distinct().orderBy("txn").limit(11).agg(F.max("txn")).first()[0]


@query(f"WITH {_J} SELECT seq, CASE WHEN state = 'pending' AND txn IN (SELECT txn FROM j WHERE txn IS NOT NULL GROUP BY txn ORDER BY txn LIMIT 1 OFFSET 10) THEN 'rolled_back' ELSE state END AS state FROM j")
def journal_rollback(spark, sf_dir):
    log = _journal(spark, sf_dir)
    return J.roll_back(log, _eleventh(log)).select("seq", "state")


@query(f"WITH {_J}, u AS (SELECT * FROM j WHERE state = 'pending' AND txn IN (SELECT txn FROM j WHERE txn IS NOT NULL GROUP BY txn ORDER BY txn LIMIT 1 OFFSET 10)) SELECT seq, key, old_value, row_number() OVER (ORDER BY seq DESC) AS turn FROM u")
def journal_rollback_undo(spark, sf_dir):
    """The entries to undo, newest first."""
    from pyspark.sql.window import Window

    log = _journal(spark, sf_dir)
    undo = J.to_undo(log, _eleventh(log))  # of one transaction, so one window over it is small
    return undo.select("seq", "key", "old_value", F.row_number().over(Window.orderBy(F.desc("seq"))).cast("long").alias("turn"))


@query(f"WITH {_J}, {_R} SELECT j.seq, CASE WHEN ok.seq IS NOT NULL THEN 'recovered' ELSE j.state END AS state FROM j LEFT JOIN ok USING (seq)")
def journal_mark_recovered(spark, sf_dir):
    log = _journal(spark, sf_dir)
    return J.mark_recovered(log, J.recoverable(log).where("recovered").select("seq")).select("seq", "state")


def _folder(spark, name):
    import uuid

    from millrace.functions.lineage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN = """w AS (SELECT c_custkey AS place, CASE WHEN c_acctbal < 0 THEN 'delete' ELSE 'put' END AS op, 'c' || c_custkey AS key, CASE WHEN c_acctbal >= 0 THEN CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) END AS value,
  CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS old_value, CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS txn FROM customer)"""


def _written(spark, sf_dir):
    c = cents(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("place"), F.when(F.col("c_acctbal") < 0, "delete").otherwise("put").alias("op"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"),
        F.when(F.col("c_acctbal") >= 0, c.cast("string")).alias("value"), c.cast("string").alias("old_value"), F.when(F.col("c_nationkey") % 3 == 0, "a").when(F.col("c_nationkey") % 3 == 1, "b").alias("txn"),
    )


@query(
    f"""WITH {_WRITTEN} SELECT place, op, key, value, CASE txn WHEN 'a' THEN 'committed' WHEN 'b' THEN 'rolled_back' ELSE 'pending' END AS state, CAST(1 AS BIGINT) AS write FROM w
UNION ALL SELECT 0, 'put', 'x', '1', 'recovered', 2 UNION ALL SELECT 0, 'delete', 'x', NULL, 'committed', 3 UNION ALL SELECT 0, 'clear', '', NULL, 'pending', 4"""
)
def journal_written(spark, sf_dir):
    """Customers are logged in one write, then a put, a delete and a clear by themselves; transaction a is committed, b rolled back."""
    journal = J.Journal(spark, _folder(spark, "journal"), compact_at=10**9)
    journal.append(_written(spark, sf_dir))
    put = journal.log_put("x", 1, txn="t")
    journal.log_delete("x", old_value=1, txn="u")
    journal.log_clear()
    journal.commit_transaction("a")
    journal.commit_transaction("u")
    undo = journal.rollback_transaction("b")
    assert undo.where("txn <> 'b'").limit(1).count() == 0
    journal.mark_recovered(spark.createDataFrame([(put,)], "seq long"))
    log = journal.log()
    return log.select(F.expr("seq & 4294967295").alias("place"), "op", "key", "value", "state", F.expr("seq >> 32").alias("write"))


@query(f"WITH {_WRITTEN} SELECT key, op, txn FROM w WHERE txn = 'b' UNION ALL SELECT 'last', 'put', NULL")
def journal_auto_compact(spark, sf_dir):
    """One entry more than the journal is meant to hold: what is closed by then is dropped."""
    rows = _written(spark, sf_dir)
    journal = J.Journal(spark, _folder(spark, "journal"), compact_at=rows.count())
    journal.append(rows)
    journal.commit_transaction("a")
    journal.commit_up_to(1 << 31)
    journal._mark(journal.log().where("txn is null"), J.ROLLED_BACK)
    assert journal.compactions == 0
    journal.log_put("last", 1)
    assert journal.compactions == 1
    return journal.log().select("key", "op", "txn")


# --- stores --------------------------------------------------------------------------------------------------


def _balances(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), cents(F.col("c_acctbal")).cast("string").alias("value_json"))


@query("SELECT 'c' || c_custkey AS key, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS value_json, CAST(3 AS BIGINT) AS generation FROM customer WHERE c_acctbal >= 0 AND c_custkey <> 1")
def store_life(spark, sf_dir):
    """All customers are put and those in debt deleted; then the log is rewritten with what is left, generations kept."""
    store = kv.TableStore(spark, _folder(spark, "store"))
    rows = _balances(spark, sf_dir)
    store.put_table(rows, generation=3)
    store.delete_table(rows.where("cast(value_json as long) < 0").select("key"))
    store.delete("c1")
    assert not store.exists("c1")
    small = store.vacuum(_folder(spark, "store"))
    return small.content().select("key", "value_json", "generation")


@query("SELECT 'c' || c_custkey AS key, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS value_json FROM customer")
def store_restore(spark, sf_dir):
    """A snapshot brings back what was overwritten, deleted and cleared since."""
    from millrace.functions.lineage import cut

    store = kv.TableStore(spark, _folder(spark, "store"))
    store.put_table(_balances(spark, sf_dir), generation=1)
    before = cut(store.snapshot())
    store.put("c1", "other")
    assert store.clear() == before.count() and store.size() == 0
    store.put("new", 1)
    store.restore(before)
    assert store.get("new") is None
    return store.content().select("key", "value_json")


@query("SELECT count(*) + 2 AS entries, count(*) + 4 AS writes, 4::BIGINT AS reads, 3::BIGINT AS hits, 1::BIGINT AS misses, 0.75::DOUBLE AS hit_rate FROM customer")
def store_stats(spark, sf_dir):
    store = kv.TableStore(spark, _folder(spark, "store"))
    store.put_table(_balances(spark, sf_dir))
    store.put_many({"x": 1, "y": [2], "z": None})
    store.delete("z")
    assert store.get_many(["c1", "x", "y", "z"])["y"] == [2]
    s = store.stats()
    return spark.createDataFrame([(s.entries, s.writes, s.reads, s.hits, s.misses, s.hit_rate)], "entries long, writes long, reads long, hits long, misses long, hit_rate double")


_LRU = """n AS (SELECT 'n' || n_nationkey AS key, row_number() OVER (ORDER BY n_nationkey) AS k, count(*) OVER () AS total FROM nation)"""


@query(f"WITH {_LRU}, last AS (SELECT key, k FROM n WHERE k > total - 9) SELECT key, CAST(row_number() OVER (ORDER BY k = (SELECT min(k) FROM last), k) - 1 AS INT) AS place, CAST((SELECT any_value(total) FROM n) - 9 AS INT) AS evicted, 1.0::DOUBLE AS utilization FROM last")
def lru_life(spark, sf_dir):
    """Nine places for all nations; reading the oldest makes it the newest, peeking does not."""
    names = [f"n{r[0]}" for r in sorted(table(spark, sf_dir, "nation").select("n_nationkey").collect())]
    cache: kv.Store = kv.LruCache(9)
    cache.put_many({n: n for n in names[:12]})
    for n in names[12:]:
        cache.put(n, n)
    assert cache.peek(cache.newest_key) == names[-1] and cache.oldest_key == names[-9]
    assert cache.get_many([names[-9], "none"]) == {names[-9]: names[-9], "none": None} and cache.newest_key == names[-9]
    rows = [(n, i, cache.evicted, cache.utilization) for i, n in enumerate(cache.keys())]
    assert cache.stats().hits == 1 and cache.exists(names[-1]) and cache.delete(names[-1]) and cache.size() == 8
    held = cache.snapshot()
    assert cache.clear() == 8
    cache.restore(held)
    assert cache.size() == 8
    return spark.createDataFrame(rows, "key string, place int, evicted int, utilization double")


# --- validation ----------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, 'c_acctbal' AS node_id, 'range' AS "constraint", 'below 0.0' AS message FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_acctbal', 'range', 'above 9000.0' FROM customer WHERE c_acctbal > 9000"""
)
def validate_range(spark, sf_dir):
    checks = Checks().between("c_acctbal", low=0.0, high=9000.0)
    return checks.violations(table(spark, sf_dir, "customer"), ["c_custkey"])


@query("""SELECT c_custkey, 'c_name' AS node_id, 'even key' AS "constraint", 'key is odd' AS message FROM customer WHERE c_custkey % 2 <> 0""")
def validate_predicate(spark, sf_dir):
    checks = Checks().holds("c_name", "even key", lambda c: F.col("c_custkey") % 2 == 0, "key is odd")
    return checks.violations(table(spark, sf_dir, "customer"), ["c_custkey"])


@query("""SELECT event_id, 'props' AS node_id, 'type' AS "constraint", 'not a bigint' AS message FROM events WHERE props IS NOT NULL AND try_cast(props AS BIGINT) IS NULL""")
def validate_type(spark, sf_dir):
    return Checks().castable("props", "bigint").violations(table(spark, sf_dir, "events"), ["event_id"])
