"""The example applications over the large tables."""

from __future__ import annotations

from examples import applications as A
from pyspark.sql import functions as F

from millrace.functions import cents
from millrace.plans.catalogue import query
from millrace.plans.evaluate import evaluate
from millrace.sources.tables import table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", cents(F.col("l_extendedprice")).alias("price"), cents(F.col("l_tax")).alias("tax_rate"), F.round("l_quantity").cast("long").alias("quantity")
    )


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_tax * 100) AS BIGINT) AS tax_rate, CAST(round(l_quantity) AS BIGINT) AS quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, price * quantity AS subtotal, price * tax_rate AS unit_tax, price * quantity + price * tax_rate * quantity AS total FROM s"""
)
def app_spreadsheet(spark, sf_dir):
    return evaluate(_lines(spark, sf_dir), A.sheet(), ["subtotal", "unit_tax", "total"]).drop("price", "tax_rate", "quantity")


@query(
    """SELECT * FROM (VALUES ('first', 'app,main.o,util.o'), ('nothing new', ''), ('a comment', 'util.o'), ('a change', 'app,main.o')) AS t(step, built)"""
)
def app_build(spark, sf_dir):
    """Nation and region names as source files: what is built anew, step by step."""
    b, rows = A.Build(spark, ["main.c", "util.c"], "app"), []
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("line"))
    b.bench.set("main.c", names)
    b.edit("util.c", "int u;")
    rows.append(("first", ",".join(sorted(b.run()))))
    rows.append(("nothing new", ",".join(sorted(b.run()))))
    b.edit("util.c", "// a comment", "int u;")
    rows.append(("a comment", ",".join(sorted(b.run()))))
    b.bench.set("main.c", names.where("line <> 'FRANCE'").union(spark.createDataFrame([("ELSEWHERE",)], "line string")))
    rows.append(("a change", ",".join(sorted(b.run()))))
    return spark.createDataFrame(rows, "step string, built string")


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, ts FROM events WHERE event_type IN ('error', 'purchase')),
l AS (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN cents END IGNORE NULLS) OVER w AS latest_alert, last_value(CASE WHEN event_type = 'purchase' THEN cents END IGNORE NULLS) OVER w AS latest_sale
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT * FROM l WHERE latest_alert IS NOT NULL AND latest_sale IS NOT NULL"""
)
def app_dashboard(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents(F.col("value")).alias("cents"))
    board = A.Dashboard.board(rows.where("event_type = 'error'"), rows.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"], "stream", "cents")
    return board.select("event_id", "user_id", "latest_alert", "latest_sale")


@query(
    """WITH s AS (SELECT o_orderkey, CAST(floor(greatest(CAST(round(o_totalprice * 100) AS BIGINT), 0) * 1020 / 1000.0::DOUBLE) AS BIGINT) - o_custkey AS net FROM orders)
SELECT o_orderkey, net * 100 - net * 8 - net * (o_orderkey % 10) AS final FROM s"""
)
def app_optimized(spark, sf_dir):
    """Pruned and fused, over all orders."""
    graph, report = A.optimised(A.revenue(), ["final"])
    assert report["nodes"] == (14, 11, 9) and report["pruned"] == ["legacy", "metric", "more_metric"] and report["fused"] == [("clean", "inflated", "rounded")]
    assert report["cost"][1] < report["cost"][0] and report["speedup"] >= 1.0
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", cents(F.col("o_totalprice")).alias("sales"), F.col("o_custkey").alias("returned"), F.lit(8).alias("tax"), (F.col("o_orderkey") % 10).alias("discount")
    )
    return evaluate(rows, graph, ["final"], keep=["o_orderkey", *graph.sources]).select("o_orderkey", "final")


_ETL = """k AS (SELECT c_nationkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS income, count(*) AS heads FROM customer GROUP BY 1),
t AS (SELECT s_nationkey, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS spending FROM supplier GROUP BY 1),
p AS (SELECT n_nationkey, greatest(coalesce(income, 0), 0) - abs(coalesce(spending, 0)) AS profit, CASE WHEN coalesce(heads, 0) > 0 THEN CAST(trunc(greatest(coalesce(income, 0), 0) / CAST(heads AS DOUBLE)) AS BIGINT) END AS per_head
  FROM nation LEFT JOIN k ON c_nationkey = n_nationkey LEFT JOIN t ON s_nationkey = n_nationkey)"""


def _etl(spark, sf_dir):
    zero = F.lit(0).cast("long")
    income = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(cents(F.col("c_acctbal"))).alias("income"), F.count("*").alias("heads"))
    spending = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum(cents(F.col("s_acctbal"))).alias("spending"))
    rows = table(spark, sf_dir, "nation").join(income, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(spending, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.select("n_nationkey", *[F.coalesce(c, zero).alias(c) for c in ("income", "spending", "heads")])
    etl = A.Etl()
    return etl, etl.ingest(rows, ["n_nationkey"])


@query(f"WITH {_ETL} SELECT n_nationkey, profit, CASE WHEN profit > 0 THEN per_head ELSE 0 END AS health, 'IN_SYNC' AS extract_state, 'IN_SYNC' AS transform_state FROM p")
def app_etl(spark, sf_dir):
    """Profit and health of nations through three federated graphs, in sync afterwards."""
    etl, rows = _etl(spark, sf_dir)
    state = etl.status()
    return rows.select("*", F.lit(state["extract to transform"]).alias("extract_state"), F.lit(state["transform to load"]).alias("transform_state"))


@query(f"WITH {_ETL} SELECT n_nationkey, 'profit' AS node, least(profit, n_nationkey * 1000) AS value, CAST(1 AS INT) AS turn FROM p UNION ALL SELECT n_nationkey, 'health', CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN profit > 0 THEN per_head ELSE 0 END ELSE n_nationkey * 1000 END, CAST(1 AS INT) FROM p")
def app_etl_conflicts(spark, sf_dir):
    """A second graph has written profits and healths too: the lower profit stays, and the health that was written last."""
    from millrace.plans.federation import conflict_history

    _, rows = _etl(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.col(n).alias("source_value")) for n in ("profit", "health")]))
    both = rows.select("n_nationkey", each.alias("e")).select("n_nationkey", F.concat_ws("", "e.node").alias("node"), "e.source_value")
    both = both.withColumns({"target_value": F.col("n_nationkey").cast("long") * 1000, "source_clock": 1 - F.col("n_nationkey") % 2, "target_clock": F.col("n_nationkey") % 2})
    done = A.Etl.settle(both)
    numbered = conflict_history(done.withColumn("node", F.concat_ws("/", "node", "n_nationkey")), "n_nationkey")
    return numbered.select("n_nationkey", F.split("node", "/")[0].alias("node"), "value", "turn")
