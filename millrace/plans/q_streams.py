"""Queries of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cents
from millrace.operators import streams as S
from millrace.plans.catalogue import query
from millrace.plans.q_history import _history, _sql
from millrace.sources.tables import table

KEYS, ORDER = ["user_id"], ["ts", "event_id"]
W = "PARTITION BY user_id ORDER BY ts, event_id"
E = "e AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents(F.col("value")).alias("cents"))


@query(_sql() + " UNION ALL ".join(f"SELECT user_id, event_id, '{n}' AS node_id, CAST(\"{n}\" AS DOUBLE) AS value, CAST({n}_old AS DOUBLE) AS old_value FROM h WHERE {n}_changed" for n in ("engagement", "alert")))
def stream_observe_emit(spark, sf_dir):
    changes = _history(spark, sf_dir).recomputed()
    return S.observe(changes, "node_id", ["engagement", "alert"]).select("user_id", "event_id", "node_id", "value", "old_value")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def overflow_drop_oldest(spark, sf_dir):
    return S.overflow(_events(spark, sf_dir), KEYS, ORDER, 10).select("event_id", "user_id")


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER ({W}) AS n FROM events) WHERE n <= 10")
def overflow_drop_newest(spark, sf_dir):
    return S.overflow(_events(spark, sf_dir), KEYS, ORDER, 10, "newest").select("event_id", "user_id")


@query("SELECT user_id, greatest(count(*) - 10, 0) AS dropped FROM events GROUP BY user_id")
def overflow_dropped_count(spark, sf_dir):
    return S.dropped_count(_events(spark, sf_dir), KEYS, 10)


@query(
    "SELECT c_mktsegment AS grp, count(*) FILTER (c_acctbal >= 1000) AS active, count(*) FILTER (c_acctbal >= 0 AND c_acctbal < 1000) AS paused, count(*) FILTER (c_acctbal < 0) AS disposed FROM customer GROUP BY 1"
)
def subscription_group_stats(spark, sf_dir):
    state = F.when(F.col("c_acctbal") < 0, "disposed").when(F.col("c_acctbal") < 1000, "paused").otherwise("active")
    return S.group_stats(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), state.alias("state")))


@query(f"SELECT event_id, user_id FROM (SELECT *, epoch_us(lead(ts) OVER ({W})) - epoch_us(ts) AS gap FROM events) WHERE gap >= 21600000000")
def stream_debounce(spark, sf_dir):
    return S.debounce(_events(spark, sf_dir), KEYS, ORDER, "ts", 6 * 3600).select("event_id", "user_id")


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER ({W}) AS n FROM events),
r AS (SELECT user_id, ts, event_id, n FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, ts, event_id, n FROM (
    SELECT e.user_id, e.ts, e.event_id, e.n, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS k
    FROM r JOIN e ON e.user_id = r.user_id AND e.n > r.n AND epoch_us(e.ts) - epoch_us(r.ts) >= 43200000000) WHERE k = 1)
SELECT event_id, user_id FROM r"""
)
def stream_throttle(spark, sf_dir):
    return S.throttle(_events(spark, sf_dir), KEYS, ORDER, "ts", 12 * 3600).select("event_id", "user_id")


_B = f"b AS (SELECT *, (row_number() OVER ({W}) - 1) // 10 AS batch FROM e), f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, batch) AS n FROM b) WHERE n = 10)"


@query(f"WITH {E}, {_B} SELECT event_id, user_id, batch FROM f")
def stream_buffer_count(spark, sf_dir):
    return S.buffer_batches(_events(spark, sf_dir), KEYS, ORDER, 10).select("event_id", "user_id", "batch")


@query(f"WITH {E}, {_B} SELECT user_id, batch, event_type, arg_max(cents, event_id) AS cents FROM f GROUP BY ALL")
def stream_buffer_last_per_node(spark, sf_dir):
    return S.last_per_node(S.buffer_batches(_events(spark, sf_dir), KEYS, ORDER, 10), KEYS, "event_type", "cents", ORDER)


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, epoch_us(ts) AS t, row_number() OVER ({W}) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS first, 1 AS k, 0::BIGINT AS batch, (1 >= 5) AS flushed FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n,
    CASE WHEN r.flushed THEN e.t ELSE r.first END, CASE WHEN r.flushed THEN 1 ELSE r.k + 1 END, CASE WHEN r.flushed THEN r.batch + 1 ELSE r.batch END,
    CASE WHEN r.flushed THEN FALSE ELSE r.k + 1 >= 5 OR e.t - r.first >= 86400000000 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, batch FROM r WHERE (user_id, batch) IN (SELECT user_id, batch FROM r WHERE flushed)"""
)
def stream_buffer_time(spark, sf_dir):
    return S.buffer_time(_events(spark, sf_dir), KEYS, ORDER, "ts", 24 * 3600, 5).select("user_id", "event_id", "batch")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, ts, event_type FROM events WHERE event_type = 'error'")
def stream_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return S.merge(rows.where("event_type = 'view'"), rows.where("event_type = 'error'"))


_L = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {E}, l AS (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN cents END IGNORE NULLS) OVER {_L} AS latest_view,
  last_value(CASE WHEN event_type = 'click' THEN cents END IGNORE NULLS) OVER {_L} AS latest_click FROM e WHERE event_type IN ('view', 'click'))
SELECT * FROM l WHERE latest_view IS NOT NULL AND latest_click IS NOT NULL"""
)
def stream_combine_latest(spark, sf_dir):
    out = S.combine_latest(_events(spark, sf_dir), KEYS, ORDER, "event_type", "cents", ["view", "click"])
    return out.select("event_id", "user_id", "latest_view", "latest_click")


_Q = """q AS (SELECT user_id AS node, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS priority, event_id AS seq,
  CAST(event_id AS DOUBLE) AS trigger_time, CAST(event_id % 7 AS DOUBLE) AS delay FROM events),
k AS (SELECT node, min(priority) AS priority, min(seq) AS seq, arg_min(delay, seq) AS delay, arg_min(trigger_time, seq) AS trigger_time FROM q GROUP BY node)"""


def _tasks(spark, sf_dir):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    asked = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("node"), rank.alias("priority"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("trigger_time"), (F.col("event_id") % 7).cast("double").alias("delay")
    )
    return S.coalesce_tasks(asked, "node", "priority", "seq", "delay")


@query(f"WITH {_Q} SELECT * FROM k")
def sched_coalesce(spark, sf_dir):
    return _tasks(spark, sf_dir)


@query(f"WITH {_Q} SELECT node, priority, seq FROM k WHERE trigger_time + delay <= 200 ORDER BY priority, seq LIMIT 20")
def sched_tick_order(spark, sf_dir):
    return S.tick(_tasks(spark, sf_dir), 200.0, 20).select("node", "priority", "seq")


@query(f"WITH {_Q} SELECT node, priority FROM k WHERE node NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def sched_cancel(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    return S.cancel(_tasks(spark, sf_dir), gone, "node").select("node", "priority")
