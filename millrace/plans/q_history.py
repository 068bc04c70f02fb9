"""Queries of the incremental core: replay, generations, cutoff, demand, snapshots, traces, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cents, same_entries
from millrace.functions.lineage import cut
from millrace.graph.blueprint import Blueprint
from millrace.operators import values as V
from millrace.plans import batches
from millrace.plans.catalogue import query
from millrace.plans.history import Differences, History, diff, diff_kinds, replay
from millrace.sources.tables import table

KEYS, ORDER = ["user_id"], ["ts", "event_id"]

#: The first third, and two thirds, of the event ids, whatever the size of the table.
_EARLY_SQL = "event_id <= (SELECT max(event_id) // 3 FROM events)"
_LATER_SQL = "event_id <= (SELECT 2 * max(event_id) // 3 FROM events)"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change log: each sets the source of its type, for its user, to its value in cents."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("input"), cents(F.col("value")).alias("value"))


def _early(spark: SparkSession, sf_dir: str, parts: int, of: int = 1) -> F.Column:
    """Whether an event is among the first of so many parts of the event ids."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return F.col("event_id") <= of * last // parts


def engagement() -> Blueprint:
    """view + click, coarse units of it, their ratio to purchases, and an alert on errors."""
    g = Blueprint()
    for s in ("view", "click", "purchase", "error"):
        g.source(s)
    g.derive("engagement", lambda c: c["view"] + c["click"], ["view", "click"])
    g.derive("coarse", lambda c: F.floor(c["engagement"] / 10000), ["engagement"])
    g.derive("step", lambda c: c["coarse"] * 2 + 1, ["coarse"])
    g.derive("alert", V.threshold("error", 10000, 1, 0, is_float=False), ["error"])
    g.derive("score", lambda c: c["step"] * 10 + c["alert"] + F.coalesce(c["purchase"], F.lit(0)) % 10, ["step", "alert", "purchase"])
    return g


def _history(spark: SparkSession, sf_dir: str) -> History:
    return replay(change_log(spark, sf_dir), engagement(), KEYS, ORDER)


NODES = ["view", "click", "purchase", "error", "engagement", "coarse", "step", "alert", "score"]
PARENTS = {"engagement": ["view", "click"], "coarse": ["engagement"], "step": ["coarse"], "alert": ["error"], "score": ["step", "alert", "purchase"]}


def _sql(extra_where: str = "") -> str:
    """The replay in DuckDB's SQL, ending in a table ``h`` like ``History.frame``."""
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    ffill = ", ".join(f"last_value(CASE WHEN event_type = '{s}' THEN c END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS \"{s}\"" for s in ("view", "click", "purchase", "error"))
    changed = ", ".join(f'"{n}" IS DISTINCT FROM lag("{n}") OVER ({w}) AS {n}_changed, lag("{n}") OVER ({w}) AS {n}_old' for n in NODES)
    evaluated = ", ".join(
        (f"({' OR '.join(f'{p}_changed' for p in PARENTS[n])})" if n in PARENTS else f"event_type = '{n}'") + f" AS {n}_evaluated" for n in NODES
    )
    gen = ", ".join(f"CAST(sum({n}_changed::INT) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {n}_generation" for n in NODES)
    return f"""
WITH log AS (SELECT user_id, ts, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error') {extra_where}),
f AS (SELECT user_id, ts, event_id, event_type, {ffill} FROM log),
e1 AS (SELECT *, "view" + click AS engagement, CASE WHEN error >= 10000 THEN 1 ELSE 0 END AS alert FROM f),
e2 AS (SELECT *, CAST(floor(engagement / 10000.0) AS BIGINT) AS coarse FROM e1),
e3 AS (SELECT *, coarse * 2 + 1 AS step FROM e2),
e4 AS (SELECT *, step * 10 + alert + coalesce(purchase, 0) % 10 AS score FROM e3),
c AS (SELECT *, {changed} FROM e4),
h AS (SELECT *, {evaluated}, {gen} FROM c)
"""


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query(
    _sql()
    + _union(
        [
            f"SELECT user_id, ts, event_id, '{n}' AS node_id, CAST(\"{n}\" AS DOUBLE) AS value, CAST({n}_old AS DOUBLE) AS old_value, {n}_generation AS generation FROM h WHERE {n}_changed"
            for n in PARENTS
        ]
    )
)
def history_propagate(spark, sf_dir):
    return _history(spark, sf_dir).recomputed()


@query(_sql() + _union([f"SELECT user_id, ts, event_id, '{n}' AS node_id, CAST(\"{n}\" AS DOUBLE) AS value FROM h WHERE {n}_evaluated AND NOT {n}_changed" for n in PARENTS]))
def history_cutoff(spark, sf_dir):
    return _history(spark, sf_dir).cut_off()


@query(_sql() + "SELECT event_id, view_generation, engagement_generation, coarse_generation, score_generation FROM h")
def history_generation(spark, sf_dir):
    names = ["view", "engagement", "coarse", "score"]
    return _history(spark, sf_dir).frame.select("event_id", *[F.col(f"{n}__generation").alias(f"{n}_generation") for n in names])


@query(
    _sql()
    + f"""SELECT user_id, (arg_max(s, event_id)).v AS score, arg_max(score_generation, event_id) AS score_generation
FROM (SELECT user_id, event_id, struct_pack(v := score) AS s, score_generation FROM h WHERE {_EARLY_SQL}) GROUP BY user_id"""
)
def history_demand_as_of(spark, sf_dir):
    h = _history(spark, sf_dir)
    return h.as_of(_early(spark, sf_dir, 3)).select("user_id", "score", F.col("score__generation").alias("score_generation"))


_VALID = " AND ".join(f"now.{p}_generation = seen.{p}_generation" for p in PARENTS["score"])


@query(
    _sql()
    + f""", seen AS (SELECT user_id, max(step_generation) AS step_generation, max(alert_generation) AS alert_generation, max(purchase_generation) AS purchase_generation FROM h WHERE {_EARLY_SQL} GROUP BY user_id),
now AS (SELECT user_id, max(step_generation) AS step_generation, max(alert_generation) AS alert_generation, max(purchase_generation) AS purchase_generation FROM h GROUP BY user_id)
SELECT user_id, {_VALID} AS valid FROM now JOIN seen USING (user_id)"""
)
def memo_validity(spark, sf_dir):
    """Whether the score remembered after a third of the events may still be used: its parents' generations are what they were."""
    h = _history(spark, sf_dir)
    parents = h.graph.parents("score")
    gens = lambda rows: rows.select("user_id", F.create_map(*[x for p in parents for x in (F.lit(p), F.col(f"{p}__generation"))]).alias("gens"))
    seen, now = gens(h.as_of(_early(spark, sf_dir, 3))), gens(h.as_of())
    return now.join(seen.withColumnRenamed("gens", "seen"), "user_id").select("user_id", same_entries(F.col("gens"), F.col("seen")).alias("valid"))


_TRACE = []
for _n in NODES:
    if _n not in PARENTS:
        _TRACE.append(f"SELECT user_id, ts, event_id, 'SOURCE_CHANGED' AS event, '{_n}' AS node_id FROM h WHERE {_n}_changed")
    else:
        _up = {"engagement": "view click", "coarse": "view click", "step": "view click", "alert": "error", "score": "view click purchase error"}[_n].split()
        _TRACE.append(f"SELECT user_id, ts, event_id, 'INVALIDATED' AS event, '{_n}' AS node_id FROM h WHERE {' OR '.join(f'{u}_changed' for u in _up)}")
        _TRACE.append(f"SELECT user_id, ts, event_id, CASE WHEN {_n}_changed THEN 'COMPUTED' ELSE 'CUT_OFF' END AS event, '{_n}' AS node_id FROM h WHERE {_n}_evaluated")


@query(_sql() + _union(_TRACE))
def trace_events(spark, sf_dir):
    return _history(spark, sf_dir).trace().drop("position")


@query(_sql() + f"SELECT user_id, ts, event_id, CAST(score AS DOUBLE) AS value FROM h WHERE {_EARLY_SQL} AND score_changed")
def replay_until(spark, sf_dir):
    log = change_log(spark, sf_dir).where(_early(spark, sf_dir, 3))
    return replay(log, engagement(), KEYS, ORDER).recomputed(["score"]).select("user_id", "ts", "event_id", "value")


@query("SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS value FROM events WHERE event_type = 'purchase' AND user_id = 7")
def replay_changes_of_node(spark, sf_dir):
    return change_log(spark, sf_dir).where((F.col("input") == "purchase") & (F.col("user_id") == 7)).select("event_id", "ts", "value")


def _snap(until: str, name: str) -> str:
    parts = [
        f"SELECT user_id, '{n}' AS node_id, {'TRUE' if n not in PARENTS else 'FALSE'} AS is_input, CAST((arg_max(struct_pack(v := \"{n}\"), event_id)).v AS DOUBLE) AS value, arg_max({n}_generation, event_id) AS generation FROM h WHERE {until} GROUP BY user_id"
        for n in NODES
    ]
    return f"{name} AS ({_union(parts)})"


@query(
    _sql()
    + f", {_snap(_EARLY_SQL, 'a')}, {_snap(_LATER_SQL, 'b')} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.node_id, b.node_id) AS node_id, a.value AS before, b.value AS after FROM a FULL JOIN b ON a.user_id = b.user_id AND a.node_id = b.node_id WHERE a.value IS DISTINCT FROM b.value"
)
def snapshot_diff(spark, sf_dir):
    h = _history(spark, sf_dir)
    return diff(h.snapshot(_early(spark, sf_dir, 3)), h.snapshot(_early(spark, sf_dir, 3, 2)), KEYS)


@query(
    _sql()
    + f""", {_snap(_EARLY_SQL, 'a')}, {_snap(_LATER_SQL, 'b')},
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.node_id, b.node_id) AS node_id, a.value AS v0, b.value AS v1, a.generation AS g0, b.generation AS g1, a.node_id IS NOT NULL AS in0, b.node_id IS NOT NULL AS in1
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.node_id = b.node_id)
SELECT user_id, node_id, 'NODE_ADDED' AS change FROM j WHERE NOT in0 UNION ALL SELECT user_id, node_id, 'NODE_REMOVED' FROM j WHERE NOT in1
UNION ALL SELECT user_id, node_id, 'VALUE_CHANGED' FROM j WHERE in0 AND in1 AND v0 IS DISTINCT FROM v1
UNION ALL SELECT user_id, node_id, 'GENERATION_ADVANCED' FROM j WHERE in0 AND in1 AND g1 > g0"""
)
def graph_diff_kinds(spark, sf_dir):
    h = _history(spark, sf_dir)
    return diff_kinds(h.snapshot(_early(spark, sf_dir, 3)), h.snapshot(_early(spark, sf_dir, 3, 2)), KEYS)


@query(_sql() + f", {_snap(_EARLY_SQL, 'a')} SELECT * FROM a")
def snapshot_capture(spark, sf_dir):
    return _history(spark, sf_dir).snapshot(_early(spark, sf_dir, 3))


# --- transactions and batches: four events make one, and an error among them fails it -------------------


def _txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return log.select("event_id", F.expr("event_id div 4").alias("txn"), F.concat_ws(":", "user_id", "input").alias("input"), "value", (F.col("input") == "error").alias("bad"))


_T = """WITH t AS (SELECT event_id, event_id // 4 AS txn, user_id || ':' || event_type AS input, CAST(round(value * 100) AS BIGINT) AS value, event_type = 'error' AS bad FROM events)
"""


@query(_T + "SELECT txn, input, arg_max(value, event_id) AS value FROM t GROUP BY txn, input")
def txn_collapse(spark, sf_dir):
    return batches.collapse(_txns(spark, sf_dir), "txn", "input", "value", "event_id")


@query(_T + "SELECT txn, input, arg_max(value, event_id) AS value FROM t WHERE txn NOT IN (SELECT txn FROM t WHERE bad) GROUP BY txn, input")
def txn_rollback(spark, sf_dir):
    log = _txns(spark, sf_dir)
    return batches.collapse(batches.without_failed(log, "txn", "bad"), "txn", "input", "value", "event_id")


@query(_T + ", k AS (SELECT txn, input, arg_max(value, event_id) AS value FROM t GROUP BY txn, input) SELECT txn, input, value IS NOT DISTINCT FROM lag(value) OVER (PARTITION BY input ORDER BY txn) AND lag(txn) OVER (PARTITION BY input ORDER BY txn) IS NOT NULL AS skipped FROM k")
def batch_skipped(spark, sf_dir):
    return batches.skipped(batches.collapse(_txns(spark, sf_dir), "txn", "input", "value", "event_id"), "txn", "input", "value").select("txn", "input", "skipped")


@query(_T + "SELECT txn, bool_and(value < 20000) AS accepted, count(*) AS n FROM t GROUP BY txn")
def batch_validated(spark, sf_dir):
    gated = batches.validated(_txns(spark, sf_dir), "txn", F.col("value") < 20000)
    return gated.groupBy("txn").agg(F.bool_and("accepted").alias("accepted"), F.count("*").alias("n"))


@query("WITH t AS (SELECT user_id, event_id, event_type = 'error' AS failed FROM events), p AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id ORDER BY event_id) - failed::INT AS before FROM t) SELECT user_id, event_id, NOT failed AS ok FROM p WHERE before = 0")
def batch_sequence_stop(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return batches.until_failure(rows, ["user_id"], "event_id", "failed").select("user_id", "event_id", (~F.col("failed")).alias("ok"))


@query(_sql() + "SELECT user_id, (arg_max(struct_pack(v := \"view\"), event_id)).v + 100 + (arg_max(struct_pack(v := click), event_id)).v AS engagement FROM h GROUP BY user_id")
def batch_dry_run(spark, sf_dir):
    state = _history(spark, sf_dir).as_of()
    return batches.dry_run(state, engagement(), {"view": F.col("view") + 100}, ["engagement"], KEYS)


@query(_sql() + "SELECT user_id, ts, event_id, 'COMPUTED' AS event, 'score' AS node_id FROM h WHERE score_evaluated AND score_changed UNION ALL SELECT user_id, ts, event_id, 'CUT_OFF', 'score' FROM h WHERE score_evaluated AND NOT score_changed")
def trace_of_node(spark, sf_dir):
    """Only what happened to one node, without its invalidations."""
    return _history(spark, sf_dir).trace(["score"], ["COMPUTED", "CUT_OFF"]).drop("position")


_TALLY = " UNION ALL ".join(f"SELECT '{n}' AS node_id, count(*) FILTER ({n}_evaluated AND {n}_changed) AS computed, count(*) FILTER ({n}_evaluated AND NOT {n}_changed) AS cut_off FROM h" for n in PARENTS)


@query(_sql() + _TALLY)
def trace_counts(spark, sf_dir):
    """How often each node was computed and how often cut off."""
    rows = _history(spark, sf_dir).trace(kinds=["COMPUTED", "CUT_OFF"])
    return rows.groupBy("node_id").agg(F.count_if(F.col("event") == "COMPUTED").alias("computed"), F.count_if(F.col("event") == "CUT_OFF").alias("cut_off"))


_KINDS = """j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.node_id, b.node_id) AS node_id, a.value AS v0, b.value AS v1, a.generation AS g0, b.generation AS g1, a.node_id IS NOT NULL AS in0, b.node_id IS NOT NULL AS in1,
  CASE WHEN NOT a.is_input AND a.value IS NULL THEN 'DIRTY' ELSE 'CLEAN' END AS s0, CASE WHEN NOT b.is_input AND b.value IS NULL THEN 'DIRTY' ELSE 'CLEAN' END AS s1 FROM a FULL JOIN b ON a.user_id = b.user_id AND a.node_id = b.node_id),
k AS (SELECT node_id, 'NODE_ADDED' AS change FROM j WHERE NOT in0 UNION ALL SELECT node_id, 'NODE_REMOVED' FROM j WHERE NOT in1
UNION ALL SELECT node_id, 'VALUE_CHANGED' FROM j WHERE in0 AND in1 AND v0 IS DISTINCT FROM v1 UNION ALL SELECT node_id, 'STATE_CHANGED' FROM j WHERE in0 AND in1 AND s0 <> s1
UNION ALL SELECT node_id, 'GENERATION_ADVANCED' FROM j WHERE in0 AND in1 AND g1 > g0)"""


@query(_sql() + f", {_snap(_EARLY_SQL, 'a')}, {_snap('TRUE', 'b')}, {_KINDS} SELECT change, count(*) AS n, (SELECT count(DISTINCT node_id) FROM k) AS nodes, (SELECT count(*) FROM k) AS changes FROM k GROUP BY change")
def diff_summary(spark, sf_dir):
    """Differences between the state after a third of the events and the last one, counted by kind; derived nodes without a value count as dirty."""
    h = _history(spark, sf_dir)
    state = F.when(~F.col("is_input") & F.col("value").isNull(), "DIRTY").otherwise("CLEAN")
    early, late = (s.withColumn("state", state) for s in (h.snapshot(_early(spark, sf_dir, 3)), h.snapshot()))
    d = Differences(cut(diff_kinds(early, late, KEYS)))
    assert d.any() and d.of("VALUE_CHANGED").limit(1).count() == 1
    return d.summary().withColumns({"nodes": F.lit(d.changed_nodes().count()).cast("long"), "changes": F.lit(d.count()).cast("long")})
