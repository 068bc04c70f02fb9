"""Queries of federation, clocks, synchronisation and conflicts, and of a composed pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cents
from millrace.graph.blueprint import Blueprint
from millrace.plans import federation as D
from millrace.plans.catalogue import query
from millrace.plans.evaluate import evaluate
from millrace.sources.tables import table


def three_graphs() -> D.Federation:
    """Extract, transform and load as graphs of their own."""
    extract, transform, load = Blueprint(), Blueprint(), Blueprint()
    for s in ("price", "quantity"):
        extract.source(s)
    extract.derive("gross", lambda c: c["price"] * c["quantity"], ["price", "quantity"])
    extract.derive("bulk", lambda c: F.when(c["quantity"] >= 25, 1).otherwise(0), ["quantity"])
    for s in ("amount", "discount", "is_bulk"):
        transform.source(s)
    transform.derive("net", lambda c: c["amount"] * (100 - c["discount"]), ["amount", "discount"])
    transform.derive("final", lambda c: c["net"] - c["is_bulk"] * 100, ["net", "is_bulk"])
    for s in ("value", "raw"):
        load.source(s)
    load.derive("saved", lambda c: c["raw"] * 100 - c["value"], ["raw", "value"])
    out = D.Federation()
    out.register("extract", extract)
    out.register("transform", transform)
    out.register("load", load)
    out.bridge("extract", "gross", "transform", "amount")
    out.bridge("extract", "bulk", "transform", "is_bulk")
    out.bridge("transform", "final", "load", "value", lambda c: c - 1)
    out.bridge("extract", "gross", "load", "raw")
    return out


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice) AS BIGINT) AS price, CAST(round(l_quantity) AS BIGINT) AS quantity, CAST(round(l_discount * 100) AS BIGINT) AS discount FROM lineitem),
f AS (SELECT *, price * quantity * (100 - discount) - CASE WHEN quantity >= 25 THEN 1 ELSE 0 END * 100 AS final FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, final, price * quantity * 100 - (final - 1) AS saved FROM f"""
)
def fed_propagate(spark, sf_dir):
    graph = three_graphs().merged()
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice").cast("long").alias("price"), F.round("l_quantity").cast("long").alias("quantity"), cents(F.col("l_discount")).alias("discount")
    )
    bind = {"extract::price": F.col("price"), "extract::quantity": F.col("quantity"), "transform::discount": F.col("discount")}
    out = evaluate(rows, graph, ["transform::final", "load::saved"], bind=bind)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("`transform::final`").alias("final"), F.col("`load::saved`").alias("saved"))


_CLOCKS = """k AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id),
j AS (SELECT a.user_id, a.v AS av, a.c AS ac, a.p AS ap, b.v AS bv, b.c AS bc, b.p AS bp FROM k a JOIN k b ON b.user_id = a.user_id + 1)"""


@query(
    f"""WITH {_CLOCKS}, d AS (SELECT *, av >= bv AND ac >= bc AND ap >= bp AND (av > bv OR ac > bc OR ap > bp) AS ab, bv >= av AND bc >= ac AND bp >= ap AND (bv > av OR bc > ac OR bp > ap) AS ba FROM j)
SELECT user_id, ab AS dominates, NOT ab AND NOT ba AS concurrent, greatest(av, bv) + greatest(ac, bc) + greatest(ap, bp) AS merged_total FROM d"""
)
def vclock_dominance(spark, sf_dir):
    names = ["view", "click", "purchase"]
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == n).alias(n) for n in names])
    clock = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    a = counts.select("user_id", clock.alias("a"))
    b = counts.select((F.col("user_id") - 1).alias("user_id"), clock.alias("b"))
    total = F.aggregate(F.map_values(D.merged_clock(F.col("a"), F.col("b"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return a.join(b, "user_id").select("user_id", D.dominates(F.col("a"), F.col("b")).alias("dominates"), D.concurrent(F.col("a"), F.col("b")).alias("concurrent"), total.alias("merged_total"))


@query(
    """WITH m AS (SELECT user_id, event_id AS seq, event_id % 2 AS graph, event_type AS node FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT user_id, event_id AS seq, event_id % 2 AS source, 1 - event_id % 2 AS target, unnest(['view', 'click']) AS node FROM events WHERE event_type = 'purchase'),
w AS (SELECT DISTINCT user_id, source, target, seq FROM s), l AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY user_id, source, target ORDER BY seq), -1) AS since FROM w)
SELECT s.user_id, s.seq, s.node, count(*) AS writes FROM s JOIN l USING (user_id, source, target, seq) JOIN m ON m.user_id = s.user_id AND m.graph = s.target AND m.node = s.node AND m.seq > l.since AND m.seq < s.seq GROUP BY ALL"""
)
def sync_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = F.col("event_id") % 2
    mutations = e.where(F.col("event_type").isin("view", "click")).select("user_id", F.col("event_id").alias("seq"), side.alias("graph"), F.col("event_type").alias("node"))
    syncs = e.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("seq"), side.alias("source"), (1 - side).alias("target"), F.explode(F.array(F.lit("view"), F.lit("click"))).alias("node")
    )
    return D.sync_conflicts(mutations, syncs, ["user_id"]).select("user_id", "seq", "node", "writes")


_CONFLICTS = """c AS (SELECT o_orderkey AS id, 'p' || o_custkey % 7 AS node, CAST(round(o_totalprice * 100) AS BIGINT) AS sv, CAST(round(o_totalprice * 100) AS BIGINT) % 1000000 * 20 AS tv, o_orderkey % 10 AS sc, o_custkey % 10 AS tc FROM orders),
p AS (SELECT *, CASE node WHEN 'p0' THEN 'first_writer' WHEN 'p1' THEN 'highest' WHEN 'p2' THEN 'lowest' WHEN 'p3' THEN 'merge' WHEN 'p4' THEN 'reject' ELSE 'last_writer' END AS policy FROM c)"""


def _conflicts(spark, sf_dir):
    price = cents(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("node"), price.alias("source_value"), (price % 1000000 * 20).alias("target_value"),
        (F.col("o_orderkey") % 10).alias("source_clock"), (F.col("o_custkey") % 10).alias("target_clock"),
    )
    policies = spark.createDataFrame([("p0", "first_writer"), ("p1", "highest"), ("p2", "lowest"), ("p3", "merge"), ("p4", "reject")], "node string, policy string")
    return D.resolve_conflicts(rows, policies, merge=lambda a, b: F.floor((a + b) / 2))


@query(
    f"""WITH {_CONFLICTS} SELECT id, policy, CASE policy WHEN 'reject' THEN NULL WHEN 'first_writer' THEN CASE WHEN sc <= tc THEN sv ELSE tv END WHEN 'highest' THEN greatest(sv, tv)
WHEN 'lowest' THEN least(sv, tv) WHEN 'merge' THEN CAST(floor((sv + tv) / 2.0) AS BIGINT) ELSE CASE WHEN sc >= tc THEN sv ELSE tv END END AS value, policy = 'reject' AS rejected FROM p"""
)
def conflict_resolve(spark, sf_dir):
    return _conflicts(spark, sf_dir).select("id", "policy", "value", "rejected")


@query(f"WITH {_CONFLICTS} SELECT node, count(*) AS n FROM p GROUP BY node HAVING count(*) >= 2000")
def conflict_frequent(spark, sf_dir):
    return D.frequent_conflicts(_conflicts(spark, sf_dir), 2000)


@query(
    """WITH sales AS (SELECT c_nationkey AS k, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS sales FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0 GROUP BY 1),
costs AS (SELECT c_nationkey AS k, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS costs FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT n_nationkey, sales, costs, sales - costs AS gross, (sales - costs) * 90 AS net FROM nation LEFT JOIN sales s ON s.k = n_nationkey LEFT JOIN costs c ON c.k = n_nationkey"""
)
def pipeline_net_profit(spark, sf_dir):
    """Filter, sum, join, tax: net profit by nation, in hundredths of a cent."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    # customers grow with the data, so the join is left to the planner, which knows the sizes
    sales = orders.where("o_totalprice > 0").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(cents(F.col("o_totalprice"))).alias("sales"))
    costs = customer.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.sum(cents(F.col("c_acctbal"))).alias("costs"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")).join(sales, "c_nationkey", "left").join(costs, "c_nationkey", "left")
    g = Blueprint()
    g.source("sales")
    g.source("costs")
    g.derive("gross", lambda c: c["sales"] - c["costs"], ["sales", "costs"])
    g.derive("net", lambda c: c["gross"] * 90, ["gross"])
    return evaluate(rows, g).withColumnRenamed("c_nationkey", "n_nationkey")
