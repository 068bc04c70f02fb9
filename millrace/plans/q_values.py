"""Queries of the value operators: map, filter, reduce, aggregates, conditionals, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import cents
from millrace.graph.blueprint import Blueprint
from millrace.operators import values as V
from millrace.operators.windows import Trailing, restarts
from millrace.plans.batches import without_failed
from millrace.plans.catalogue import query
from millrace.plans.evaluate import evaluate
from millrace.sources.tables import table

C = "CAST(round(value * 100) AS BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents(F.col("value")).alias("cents"))


def _one(name: str, build: V.Builder, *parents: str) -> Blueprint:
    g = Blueprint()
    for p in parents:
        g.source(p)
    g.derive(name, build, parents)
    return g


@query(f"SELECT event_id, {C} * 2 AS doubled FROM events")
def map_elementwise(spark, sf_dir):
    g = _one("doubled", V.map_value("cents", lambda x: x * 2), "cents")
    return evaluate(_events(spark, sf_dir), g, ["doubled"], keep=["event_id", "cents"]).drop("cents")


@query(
    "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)) AS scaled FROM embeddings"
)
def map_array(spark, sf_dir):
    g = _one("scaled", V.map_each("embedding", lambda x: x.cast("double") * 2), "embedding")
    rows = evaluate(table(spark, sf_dir, "embeddings"), g, ["scaled"], keep=["vec_id", "embedding"])
    return rows.select("vec_id", F.posexplode("scaled").alias("place", "scaled")).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT event_id, {C} + 10 AS a, ({C} + 10) * 3 AS b, ({C} + 10) * 3 - 1 AS c FROM events")
def map_chain(spark, sf_dir):
    g = Blueprint()
    g.source("cents")
    V.map_chain(g, ["a", "b", "c"], "cents", [lambda x: x + 10, lambda x: x * 3, lambda x: x - 1])
    return evaluate(_events(spark, sf_dir), g, ["a", "b", "c"], keep=["event_id", "cents"]).drop("cents")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def filter_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive FROM customer")
def filter_scalar_null(spark, sf_dir):
    g = _one("positive", V.keep_if("c_acctbal", lambda x: x > 0), "c_acctbal")
    return evaluate(table(spark, sf_dir, "customer"), g, ["positive"], keep=["c_custkey", "c_acctbal"]).drop("c_acctbal")


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n_positive FROM embeddings")
def filter_array(spark, sf_dir):
    g = _one("kept", V.keep_each("embedding", lambda x: x > 0), "embedding")
    rows = evaluate(table(spark, sf_dir, "embeddings"), g, ["kept"], keep=["vec_id", "embedding"])
    return rows.select("vec_id", F.size("kept").cast("long").alias("n_positive"))


@query(
    f"""
SELECT user_id, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list({C} ORDER BY ts, event_id)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS folded
FROM events GROUP BY user_id"""
)
def reduce_fold_ordered(spark, sf_dir):
    lists = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "cents"))).alias("rows"))
    lists = lists.select("user_id", F.transform("rows", lambda r: r["cents"]).alias("items"))
    g = _one("folded", V.fold("items", lambda a, x: (a * 31 + x) % 1000003, F.lit(7).cast("long")), "items")
    return evaluate(lists, g, ["folded"], keep=["user_id", "items"]).drop("items")


@query(f"SELECT user_id, CAST(sum({C}) AS BIGINT) AS total FROM events GROUP BY user_id")
def reduce_sum(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.sum("cents").alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_partkey + l_suppkey + l_linenumber AS folded FROM lineitem")
def reduce_multi_source(spark, sf_dir):
    names = ["l_partkey", "l_suppkey", "l_linenumber"]
    g = _one("folded", V.fold_sources(names, lambda a, x: a + x), *names)
    return evaluate(table(spark, sf_dir, "lineitem"), g, ["folded"], keep=["l_orderkey", *names]).select("l_orderkey", "l_linenumber", "l_partkey", "folded")


@query(
    "SELECT vec_id, CAST(coalesce(list_sum(list_filter(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT) * 3), lambda x: x > 25)), 0) AS BIGINT) AS total FROM embeddings"
)
def map_filter_reduce(spark, sf_dir):
    g = Blueprint()
    g.source("embedding")
    g.derive("mapped", V.map_each("embedding", lambda x: F.floor(x.cast("double") * 100) * 3), ["embedding"])
    g.derive("kept", V.keep_each("mapped", lambda x: x > 25), ["mapped"])
    g.derive("total", V.fold("kept", lambda a, x: a + x, F.lit(0).cast("long")), ["kept"])
    return evaluate(table(spark, sf_dir, "embeddings"), g, ["total"], keep=["vec_id", "embedding"]).drop("embedding")


# --- aggregates across sources: quantity, discount and tax in hundredths, zeros counting as null -----------

_SOURCES = ["q", "d", "t"]
_AGG = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(CAST(round(l_quantity) AS BIGINT) % 3, 0) AS q,
  nullif(CAST(round(l_discount * 100) AS BIGINT), 0) AS d, nullif(CAST(round(l_tax * 100) AS BIGINT), 0) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {} AS result FROM s"""


def _agg(spark: SparkSession, sf_dir: str, build: V.Builder) -> DataFrame:
    none = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.nullif(F.round("l_quantity").cast("long") % 3, none).alias("q"),
        F.nullif(cents(F.col("l_discount")), none).alias("d"),
        F.nullif(cents(F.col("l_tax")), none).alias("t"),
    )
    return evaluate(rows, _one("result", build, *_SOURCES), ["result"]).drop(*_SOURCES)


@query(_AGG.format("CASE WHEN q IS NOT NULL OR d IS NOT NULL OR t IS NOT NULL THEN coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0) END"))
def agg_sum(spark, sf_dir):
    return _agg(spark, sf_dir, V.total(_SOURCES))


@query(
    _AGG.format(
        "CAST(coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0) AS DOUBLE) / nullif((q IS NOT NULL)::INT + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT, 0)"
    )
)
def agg_average(spark, sf_dir):
    return _agg(spark, sf_dir, V.mean(_SOURCES))


@query(_AGG.format("least(q, d, t)"))
def agg_min(spark, sf_dir):
    return _agg(spark, sf_dir, V.smallest(_SOURCES))


@query(_AGG.format("greatest(q, d, t)"))
def agg_max(spark, sf_dir):
    return _agg(spark, sf_dir, V.largest(_SOURCES))


@query(_AGG.format("CAST(nullif((q IS NOT NULL)::INT + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT, 0) AS BIGINT)"))
def agg_count(spark, sf_dir):
    return _agg(spark, sf_dir, V.count_known(_SOURCES))


@query(
    _AGG.format(
        "CASE WHEN q IS NOT NULL OR d IS NOT NULL OR t IS NOT NULL THEN CAST(coalesce(q, 1) AS DOUBLE) * coalesce(d, 1) * coalesce(t, 1) END"
    )
)
def agg_product(spark, sf_dir):
    return _agg(spark, sf_dir, V.product(_SOURCES))


@query(_AGG.format("coalesce(q, -1) * 100 + coalesce(d, -1) * 10 + coalesce(t, -1)"))
def agg_custom(spark, sf_dir):
    none = F.lit(-1).cast("long")
    return _agg(spark, sf_dir, V.combine(_SOURCES, lambda c: F.coalesce(c[0], none) * 100 + F.coalesce(c[1], none) * 10 + F.coalesce(c[2], none)))


@query(_AGG.format("(coalesce(CAST(q AS DOUBLE), 0.0) * 0.5::DOUBLE + coalesce(CAST(d AS DOUBLE), 0.0) * 0.25::DOUBLE + coalesce(CAST(t AS DOUBLE), 0.0) * 0.25::DOUBLE) / 1.0::DOUBLE"))
def agg_weighted(spark, sf_dir):
    return _agg(spark, sf_dir, V.weighted(_SOURCES, [0.5, 0.25, 0.25]))


_OPS = ["sum", "average", "min", "max", "count", "product"]


@query(
    _AGG.format(
        """CASE WHEN q IS NOT NULL OR d IS NOT NULL OR t IS NOT NULL THEN coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0) END AS a_sum, CAST(coalesce(q, 0) + coalesce(d, 0) + coalesce(t, 0) AS DOUBLE) / nullif((q IS NOT NULL)::INT + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT, 0) AS a_average,
  least(q, d, t) AS a_min, greatest(q, d, t) AS a_max, CAST(nullif((q IS NOT NULL)::INT + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT, 0) AS BIGINT) AS a_count,
  CASE WHEN q IS NOT NULL OR d IS NOT NULL OR t IS NOT NULL THEN CAST(coalesce(q, 1) AS DOUBLE) * coalesce(d, 1) * coalesce(t, 1) END AS a_product, 1"""
    )
)
def agg_by_name(spark, sf_dir):
    """Every aggregate by its name, in one blueprint; an unknown name is refused."""

    def all_of(c):
        try:
            V.aggregate("median", _SOURCES)
        except ValueError:
            return F.struct(*[V.aggregate(op, _SOURCES)(c).alias(f"a_{op}") for op in _OPS])
        raise AssertionError("median is no aggregate")

    rows = _agg(spark, sf_dir, all_of)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "result.*", F.lit(1).alias("result"))


# --- conditionals ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN l_suppkey ELSE l_partkey END AS picked FROM lineitem")
def cond_if(spark, sf_dir):
    g = _one("picked", V.choose("l_tax", "l_suppkey", "l_partkey", T.DoubleType()), "l_tax", "l_suppkey", "l_partkey")
    rows = evaluate(table(spark, sf_dir, "lineitem"), g, ["picked"], keep=["l_orderkey", "l_linenumber", "l_tax", "l_suppkey", "l_partkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "picked")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE c_acctbal * 2 END AS result FROM customer")
def cond_predicate(spark, sf_dir):
    g = _one("result", V.choose_if("c_acctbal", lambda x: x < 0, lambda x: -x, lambda x: x * 2), "c_acctbal")
    return evaluate(table(spark, sf_dir, "customer"), g, ["result"], keep=["c_custkey", "c_acctbal"]).drop("c_acctbal")


@query("SELECT event_id, CASE WHEN value >= 100 AND NOT isnan(value) THEN 'OVERHEAT' ELSE 'NORMAL' END AS level FROM events")
def cond_threshold(spark, sf_dir):
    g = _one("level", V.threshold("value", 100.0, "OVERHEAT", "NORMAL"), "value")
    return evaluate(table(spark, sf_dir, "events"), g, ["level"], keep=["event_id", "value"]).drop("value")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_custkey WHEN 'F' THEN o_orderkey ELSE NULL END AS picked FROM orders")
def switch_source(spark, sf_dir):
    g = _one("picked", V.switch("o_orderstatus", {"O": "o_custkey", "F": "o_orderkey"}), "o_orderstatus", "o_custkey", "o_orderkey")
    return evaluate(table(spark, sf_dir, "orders"), g, ["picked"], keep=["o_orderkey", "o_orderstatus", "o_custkey"]).select("o_orderkey", "picked")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN -l_suppkey WHEN 'A' THEN l_suppkey + l_partkey ELSE l_partkey END AS result FROM lineitem"
)
def switch_computed(spark, sf_dir):
    cases = {"R": lambda c: -c["l_suppkey"], "A": lambda c: c["l_suppkey"] + c["l_partkey"]}
    g = _one("result", V.switch_computed("l_returnflag", cases, lambda c: c["l_partkey"]), "l_returnflag", "l_suppkey", "l_partkey")
    rows = evaluate(table(spark, sf_dir, "lineitem"), g, ["result"], keep=["l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_partkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "result")


# --- windows -----------------------------------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_W3 = f"({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _window(size: int) -> Trailing:
    return Trailing(["user_id"], ["ts", "event_id"], size)


@query(f"SELECT event_id, CAST(sum({C}) OVER {_W3} AS BIGINT) AS moving FROM events")
def window_moving_sum(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", _window(3).total(F.col("cents")).alias("moving"))


@query(f"SELECT event_id, CAST(sum({C}) OVER {_W3} AS DOUBLE) / count(*) OVER {_W3} AS moving FROM events")
def window_moving_average(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", _window(3).mean(F.col("cents")).alias("moving"))


@query(f"SELECT event_id, max({C}) OVER {_W3} - min({C}) OVER {_W3} AS spread FROM events")
def window_custom_range(spark, sf_dir):
    spread = _window(3).custom(F.col("cents"), lambda v: F.array_max(v) - F.array_min(v))
    return _events(spark, sf_dir).select("event_id", spread.alias("spread"))


@query(
    f"""SELECT event_id, lag({C}, 3) OVER ({_W}) AS evicted, CAST(least(row_number() OVER ({_W}), 3) AS BIGINT) AS filled,
  first_value({C}) OVER {_W3} AS oldest, row_number() OVER ({_W}) >= 3 AS is_full FROM events"""
)
def window_buffer(spark, sf_dir):
    w, c = _window(3), F.col("cents")
    return _events(spark, sf_dir).select("event_id", w.evicted(c).alias("evicted"), w.filled().cast("long").alias("filled"), w.oldest(c).alias("oldest"), w.is_full().alias("is_full"))


@query(
    f"""WITH r AS (SELECT *, {C} AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS filled, CAST(list(c ORDER BY ts, event_id)[1] AS BIGINT) AS oldest, CAST(list(c ORDER BY ts, event_id)[-1] AS BIGINT) AS newest, CAST(sum(c) AS BIGINT) AS total FROM r WHERE k <= 3 GROUP BY user_id"""
)
def window_get_buffer(spark, sf_dir):
    """The windows as they are left after all events."""
    held = _window(3).last_buffer(_events(spark, sf_dir), F.col("cents"))
    return held.select(
        "user_id", F.size("values").cast("long").alias("filled"), F.element_at("values", 1).alias("oldest"), F.element_at("values", -1).alias("newest"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    )


@query(
    f"""WITH s AS (SELECT *, {C} AS c, sum((event_type = 'error')::INT) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM events)
SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id, since ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM s"""
)
def window_clear(spark, sf_dir):
    """Every error empties its user's window."""
    rows = restarts(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "since")
    return rows.select("event_id", Trailing(["user_id", "since"], ["ts", "event_id"], 3).total(F.col("cents")).alias("moving"))


@query(
    f"""WITH t AS (SELECT *, {C} AS c, event_id // 4 AS txn FROM events), k AS (SELECT * FROM t WHERE txn NOT IN (SELECT txn FROM t WHERE event_type = 'error'))
SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM k"""
)
def window_rollback(spark, sf_dir):
    """Transactions of four events, of which those with an error are rolled back: windows are as if they had never been."""
    log = _events(spark, sf_dir).withColumn("txn", F.expr("event_id div 4")).withColumn("bad", F.col("event_type") == "error")
    return without_failed(log, "txn", "bad").select("event_id", _window(3).total(F.col("cents")).alias("moving"))
