"""Queries of graph analysis, over the key hierarchy of the tables: region, nation, customer and supplier, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.lineage import cut
from millrace.plans import graphs as G
from millrace.plans.catalogue import query
from millrace.sources.tables import table


def _id(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges made distinct and written once."""
    nodes, edges = rows_of_hierarchy(spark, sf_dir)
    return nodes, G.edge_table(edges)


def rows_of_hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions are sources; an order depends on its customer and on the suppliers of its line items. An edge for each row, so some repeat."""
    t = lambda n: table(spark, sf_dir, n)
    edges = (
        t("nation").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst"))
        .union(t("customer").select(_id("n", "c_nationkey"), _id("c", "c_custkey")))
        .union(t("supplier").select(_id("n", "s_nationkey"), _id("s", "s_suppkey")))
        .union(t("orders").select(_id("c", "o_custkey"), _id("o", "o_orderkey")))
        .union(t("lineitem").select(_id("s", "l_suppkey"), _id("o", "l_orderkey")))
    )
    nodes = (
        t("region").select(_id("r", "r_regionkey").alias("node_id"), F.lit("source").alias("kind"))
        .union(t("nation").select(_id("n", "n_nationkey"), F.lit("derived")))
        .union(t("customer").select(_id("c", "c_custkey"), F.lit("derived")))
        .union(t("supplier").select(_id("s", "s_suppkey"), F.lit("derived")))
        .union(t("orders").select(_id("o", "o_orderkey"), F.lit("derived")))
    )
    return nodes, edges


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


H = """WITH RECURSIVE edges AS (
SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
UNION SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier
UNION SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders UNION SELECT 's:' || l_suppkey, 'o:' || l_orderkey FROM lineitem),
nodes AS (SELECT 'r:' || r_regionkey AS node_id, 'source' AS kind FROM region UNION ALL SELECT 'n:' || n_nationkey, 'derived' FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'derived' FROM customer UNION ALL SELECT 's:' || s_suppkey, 'derived' FROM supplier UNION ALL SELECT 'o:' || o_orderkey, 'derived' FROM orders)"""


def _walk(seed: str, reverse: bool = False, name: str = "w") -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f", {name} AS (SELECT seed, node_id, 0 AS depth FROM ({seed}) UNION SELECT {name}.seed, e.{b}, {name}.depth + 1 FROM {name} JOIN edges e ON e.{a} = {name}.node_id)"


def _seed(*ids: str) -> str:
    return " UNION ALL ".join(f"SELECT '{i}' AS seed, '{i}' AS node_id" for i in ids)


@query(H + _walk(_seed("n:3")) + " SELECT node_id, CAST(min(depth) AS INT) AS depth FROM w WHERE depth > 0 GROUP BY node_id")
def graph_downstream(spark, sf_dir):
    _, edges = hierarchy(spark, sf_dir)
    return G.downstream(edges, _seeds(spark, "n:3"))


@query(H + _walk(_seed("o:1"), True) + " SELECT node_id, CAST(min(depth) AS INT) AS depth FROM w WHERE depth > 0 GROUP BY node_id")
def graph_upstream(spark, sf_dir):
    _, edges = hierarchy(spark, sf_dir)
    return G.upstream(edges, _seeds(spark, "o:1"))


@query(H + _walk(_seed("r:0")) + ", m AS (SELECT node_id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY node_id) SELECT CAST(depth AS INT) AS depth, count(*) AS n FROM m GROUP BY depth")
def graph_layers(spark, sf_dir):
    _, edges = hierarchy(spark, sf_dir)
    return G.downstream(edges, _seeds(spark, "r:0")).groupBy("depth").agg(F.count("*").alias("n"))


@query(
    H
    + _walk(_seed("r:0", "n:3", "c:1"))
    + ", m AS (SELECT seed, node_id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY ALL), b AS (SELECT seed, count(*) AS affected, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM nodes WHERE kind = 'derived') AS blast_radius, CAST(max(depth) AS INT) AS depth FROM m GROUP BY seed) SELECT *, blast_radius < 0.2 AS is_localized, blast_radius > 0.5 AS is_widespread FROM b"
)
def impact_blast_radius(spark, sf_dir):
    nodes, edges = hierarchy(spark, sf_dir)
    seeds = _seeds(spark, "r:0", "n:3", "c:1").withColumn("seed", F.col("node_id"))
    return G.impact(nodes, edges, seeds, ("seed",))


@query(H + _walk("SELECT node_id AS seed, node_id FROM nodes WHERE kind = 'source'") + " SELECT seed, count(DISTINCT node_id) AS affected FROM w WHERE depth > 0 GROUP BY seed")
def impact_sensitivity(spark, sf_dir):
    nodes, edges = hierarchy(spark, sf_dir)
    seeds = nodes.where("kind = 'source'").select(F.col("node_id").alias("seed"), "node_id")
    return G.impact(nodes, edges, seeds, ("seed",)).select("seed", "affected")


@query(
    H
    + _walk(_seed("r:0", "r:1"))
    + ", d AS (SELECT DISTINCT seed, node_id FROM w WHERE depth > 0) SELECT node_id, CASE WHEN count(*) = 2 THEN 'both' WHEN min(seed) = 'r:0' THEN 'only_a' ELSE 'only_b' END AS side FROM d GROUP BY node_id"
)
def impact_compare(spark, sf_dir):
    _, edges = hierarchy(spark, sf_dir)
    return G.compare_impacts(edges, _seeds(spark, "r:0"), _seeds(spark, "r:1"))


@query(
    H
    + _walk(_seed("o:1", "o:2", "o:3"), True)
    + ", d AS (SELECT DISTINCT seed, node_id FROM w WHERE depth > 0 AND node_id LIKE 'r:%') SELECT node_id FROM d GROUP BY node_id HAVING count(*) = 3"
)
def impact_shared_inputs(spark, sf_dir):
    nodes, edges = hierarchy(spark, sf_dir)
    return G.shared_sources(nodes, edges, _seeds(spark, "o:1", "o:2", "o:3"))


@query(H + _walk(_seed("n:3")) + ", d AS (SELECT DISTINCT node_id FROM w WHERE depth > 0) SELECT node_id FROM d WHERE node_id NOT IN (SELECT src FROM edges WHERE dst IN (SELECT node_id FROM d))")
def impact_isolated(spark, sf_dir):
    _, edges = hierarchy(spark, sf_dir)
    return G.isolated_effects(edges, _seeds(spark, "n:3"))


_LEVELS = _walk("SELECT node_id AS seed, node_id FROM nodes WHERE kind = 'source'") + ", lv AS (SELECT node_id, CAST(max(depth) AS INT) AS level FROM w GROUP BY node_id UNION ALL SELECT node_id, 0 FROM nodes WHERE node_id NOT IN (SELECT node_id FROM w))"


@query(H + _LEVELS + " SELECT node_id, level FROM lv")
def opt_levels(spark, sf_dir):
    return G.levels(*rows_of_hierarchy(spark, sf_dir))


@query(H + _LEVELS + " SELECT level, count(*) AS n FROM lv GROUP BY level")
def opt_parallelism_profile(spark, sf_dir):
    return G.levels(*rows_of_hierarchy(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query(H + _LEVELS + " SELECT node_id, level FROM lv WHERE level IN (SELECT level FROM lv GROUP BY level HAVING count(*) <= 30)")
def opt_bottlenecks(spark, sf_dir):
    return G.bottleneck_levels(*rows_of_hierarchy(spark, sf_dir), most=30)


@query(H + _walk("SELECT 'o:' || o_orderkey AS seed, 'o:' || o_orderkey AS node_id FROM orders WHERE o_orderstatus = 'P'", True) + " SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM w)")
def opt_dead_nodes(spark, sf_dir):
    """The outputs are the orders in progress."""
    nodes, edges = hierarchy(spark, sf_dir)
    outputs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(_id("o", "o_orderkey").alias("node_id"))
    return G.dead_nodes(nodes, edges, outputs)


@query("SELECT 'c:' || c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def opt_orphan_inputs(spark, sf_dir):
    """Customers as sources of open orders: those without any."""
    nodes = table(spark, sf_dir, "customer").select(_id("c", "c_custkey").alias("node_id"), F.lit("source").alias("kind"))
    edges = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst"))
    return G.orphan_sources(nodes, edges)


@query(
    """WITH c AS (SELECT 'c:' || c_custkey AS node_id, 'c:' || c_custkey AS component FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey FROM orders)
SELECT component, count(*) AS n FROM c GROUP BY component"""
)
def opt_components(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(_id("c", "c_custkey").alias("node_id"))
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst"))
    nodes = customers.union(orders.select(_id("o", "o_orderkey")))
    return G.components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))


_ALL = """WITH e AS (SELECT DISTINCT 'p:' || l_partkey AS src, 'o:' || l_orderkey AS dst FROM lineitem UNION SELECT 'o:' || o_orderkey, 'c:' || o_custkey FROM orders)"""


@query(
    _ALL
    + """, o1 AS (SELECT src FROM e GROUP BY src HAVING count(*) = 1), i1 AS (SELECT dst FROM e GROUP BY dst HAVING count(*) = 1),
l AS (SELECT src, dst FROM e WHERE src IN (SELECT src FROM o1) AND dst IN (SELECT dst FROM i1)),
h AS (SELECT src AS head, dst FROM l WHERE src NOT IN (SELECT dst FROM l))
SELECT head, CAST(CASE WHEN l.src IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n FROM h LEFT JOIN l ON l.src = h.dst"""
)
def opt_chains(spark, sf_dir):
    """Parts, orders, customers: runs in which each has one successor with one predecessor."""
    lines = table(spark, sf_dir, "lineitem").select(_id("p", "l_partkey").alias("src"), _id("o", "l_orderkey").alias("dst"))
    edges = cut(lines.union(table(spark, sf_dir, "orders").select(_id("o", "o_orderkey"), _id("c", "o_custkey"))).distinct())
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return G.chains(nodes, edges)


_DEG = """, d AS (SELECT node_id, kind, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM nodes
LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = node_id LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = node_id)"""


@query(H + _DEG + " SELECT node_id, 1.0::DOUBLE * (0.001::DOUBLE + 0.0005::DOUBLE * fan_in) + 0.001::DOUBLE * ((1024 + 512 * fan_in) / 1024.0::DOUBLE) + 0.05::DOUBLE * fan_in + 0.02::DOUBLE * fan_out AS cost FROM d")
def opt_cost_rank(spark, sf_dir):
    return G.cost_rank(*hierarchy(spark, sf_dir))


@query(H + _DEG + " SELECT fan_in AS degree, count(*) AS n FROM d GROUP BY 1")
def graph_fan_in_distribution(spark, sf_dir):
    return G.degree_distribution(*hierarchy(spark, sf_dir))


@query(H + _DEG + " SELECT fan_out AS degree, count(*) AS n FROM d GROUP BY 1")
def graph_fan_out_distribution(spark, sf_dir):
    return G.degree_distribution(*hierarchy(spark, sf_dir), "fan_out")


@query(
    H
    + _LEVELS
    + _DEG
    + """, s AS (SELECT count(*) AS n_nodes, CAST(sum(fan_out) AS BIGINT) AS n_edges, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out, CAST(sum(fan_in) AS DOUBLE) / count(*) AS avg_fan_in FROM d),
l AS (SELECT max(level) + 1 AS depth, max(n) AS width FROM (SELECT level, count(*) AS n FROM lv GROUP BY level))
SELECT n_nodes, n_edges, max_fan_in, max_fan_out, avg_fan_in, depth, width, n_edges / (n_nodes * (n_nodes - 1) / 2) AS density,
(SELECT round(-sum(fan_out / CAST(n_edges AS DOUBLE) * log2(fan_out / CAST(n_edges AS DOUBLE))), 6) FROM d WHERE fan_out > 0) AS entropy FROM s, l"""
)
def graph_complexity(spark, sf_dir):
    """The entropy is rounded, since the order of adding shows in its last digits."""
    return G.complexity(*hierarchy(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@query(H + _DEG + " SELECT node_id, fan_out, least(1.0, fan_out / 10.0)::DOUBLE AS severity FROM d WHERE fan_out >= 3")
def graph_fan_out(spark, sf_dir):
    return G.fan_out_bottlenecks(*hierarchy(spark, sf_dir))


@query(H + _DEG + " SELECT node_id, fan_in, least(1.0, fan_in / 10.0)::DOUBLE AS severity FROM d WHERE fan_in >= 3")
def graph_fan_in(spark, sf_dir):
    return G.fan_in_aggregations(*hierarchy(spark, sf_dir))


@query(
    H
    + _walk("SELECT DISTINCT src AS seed, src AS node_id FROM edges", True)
    + ", a AS (SELECT DISTINCT seed, node_id FROM w), s AS (SELECT e.dst, a.node_id FROM edges e JOIN a ON a.seed = e.src GROUP BY ALL HAVING count(*) > 1) SELECT dst AS node_id, count(*) AS n_shared FROM s GROUP BY dst"
)
def graph_diamonds(spark, sf_dir):
    _, edges = hierarchy(spark, sf_dir)
    return G.diamonds(edges)


_STATE = ", st AS (SELECT node_id, CASE WHEN kind = 'derived' AND length(node_id) % 4 = 0 THEN 'DIRTY' ELSE 'CLEAN' END AS state FROM nodes)"


@query(H + _STATE + " SELECT DISTINCT e.dst AS node_id FROM edges e JOIN st a ON a.node_id = e.src JOIN st b ON b.node_id = e.dst WHERE a.state = 'DIRTY' AND b.state = 'CLEAN'")
def integrity_clean_with_dirty_dep(spark, sf_dir):
    nodes, edges = hierarchy(spark, sf_dir)
    state = F.when((F.col("kind") == "derived") & (F.length("node_id") % 4 == 0), "DIRTY").otherwise("CLEAN")
    return G.stale_children(nodes.withColumn("state", state), edges)


@query(
    """WITH n AS (SELECT 'c:' || c_custkey AS node_id, 'source' AS kind FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'o:' || o_orderkey, 'derived' FROM orders),
e AS (SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders)
SELECT 'WARNING' AS severity, 'ORPHAN_SOURCE' AS issue, node_id FROM n WHERE kind = 'source' AND node_id NOT IN (SELECT src FROM e)
UNION ALL SELECT 'ERROR', 'UNREACHABLE', node_id FROM n WHERE kind = 'derived' AND node_id NOT IN (SELECT dst FROM e WHERE src IN (SELECT node_id FROM n))
UNION ALL SELECT 'ERROR', 'MISSING_NODE', dst FROM e WHERE src NOT IN (SELECT node_id FROM n)"""
)
def integrity_check_all(spark, sf_dir):
    """A damaged catalogue: customers in debt are missing, though orders refer to them."""
    orders = table(spark, sf_dir, "orders")
    nodes = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(_id("c", "c_custkey").alias("node_id"), F.lit("source").alias("kind"))
    nodes = nodes.union(orders.select(_id("o", "o_orderkey"), F.lit("derived")))
    return G.integrity(nodes, orders.select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst")))


@query(H + _LEVELS + ", s AS (SELECT level, count(*) AS n FROM lv GROUP BY level) SELECT count(*) AS depth, max(n) AS width, CAST(sum(n) AS DOUBLE) / count(*) AS parallelism, max(n) <= 1 AS is_linear, max(n) > count(*) AS is_wide FROM s")
def graph_shape(spark, sf_dir):
    return G.shape(*rows_of_hierarchy(spark, sf_dir))


@query(H + _walk(_seed("r:0", "n:3")) + " SELECT node_id, CAST(max(depth) AS INT) AS depth FROM w GROUP BY node_id HAVING max(depth) > 0")
def impact_longest_depth(spark, sf_dir):
    """The longest way of a change to each node it touches; a seed below another seed counts from that one."""
    _, edges = hierarchy(spark, sf_dir)
    return G.longest_depths(edges, _seeds(spark, "r:0", "n:3"))


_BOTH = (
    _walk("SELECT node_id AS seed, node_id FROM nodes WHERE node_id LIKE 'n:%'")
    + _walk("SELECT node_id AS seed, node_id FROM nodes WHERE node_id LIKE 'n:%'", True, "u")
    + ", r AS (SELECT seed, node_id FROM w WHERE depth > 0 UNION ALL SELECT seed, node_id FROM u WHERE depth > 0), q AS (SELECT seed AS node_id, count(DISTINCT node_id) AS related FROM r GROUP BY seed)"
)


@query(H + _BOTH + " SELECT node_id, related FROM q WHERE related >= 0.05 * (SELECT count(*) FROM nodes)")
def graph_critical_nodes(spark, sf_dir):
    """Nations to which a twentieth of all nodes is related, upwards or downwards."""
    nodes, edges = hierarchy(spark, sf_dir)
    return G.critical_nodes(nodes, edges, nodes.where("node_id like 'n:%'").select("node_id"), 0.05)


# customers, orders and parts as a graph in which chains occur: a customer's only order, an order's only part
_P = """WITH edges AS (SELECT 'n:' || c_nationkey AS src, 'c:' || c_custkey AS dst FROM customer UNION SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders),
d AS (SELECT node_id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges)
LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = node_id LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = node_id),
l AS (SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM d WHERE fan_out = 1) AND dst IN (SELECT node_id FROM d WHERE fan_in = 1)),
h AS (SELECT l.src AS head, CASE WHEN m.src IS NULL THEN 2 ELSE 3 END AS n FROM l LEFT JOIN l m ON m.src = l.dst WHERE l.src NOT IN (SELECT dst FROM l)),
p AS (SELECT 'FAN_OUT' AS kind, node_id, least(1.0, fan_out / 10.0)::DOUBLE AS severity FROM d WHERE fan_out >= 3
UNION ALL SELECT 'FAN_IN', node_id, least(1.0, fan_in / 10.0)::DOUBLE FROM d WHERE fan_in >= 3
UNION ALL SELECT 'CHAIN', head, least(1.0, n / 20.0)::DOUBLE FROM h WHERE n >= 3)"""


def _customers(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    edges = t("customer").select(_id("n", "c_nationkey").alias("src"), _id("c", "c_custkey").alias("dst")).union(t("orders").select(_id("c", "o_custkey"), _id("o", "o_orderkey")))
    edges = cut(edges.distinct())
    return edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct(), edges


@query(_P + " SELECT kind, node_id, severity FROM p")
def graph_patterns(spark, sf_dir):
    """All patterns of the tree of nations, customers and orders, which has no diamonds."""
    return G.patterns(*_customers(spark, sf_dir))


@query(_P + " SELECT kind, count(*) AS n FROM p GROUP BY kind")
def graph_pattern_counts(spark, sf_dir):
    return G.pattern_counts(*_customers(spark, sf_dir))


@query(H + _walk(_seed("n:3")) + " SELECT n.node_id, CASE WHEN n.kind = 'derived' AND n.node_id IN (SELECT node_id FROM w WHERE depth > 0) THEN 'DIRTY' ELSE 'CLEAN' END AS state FROM nodes n")
def graph_mark_dirty(spark, sf_dir):
    nodes, edges = hierarchy(spark, sf_dir)
    return G.marked_dirty(nodes, edges, _seeds(spark, "n:3")).select("node_id", "state")


@query(
    """WITH n AS (SELECT 'c:' || c_custkey AS node_id, 'source' AS kind FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'o:' || o_orderkey, 'derived' FROM orders),
e AS (SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders),
i AS (SELECT 1 AS rank, 'WARNING' AS severity, 'ORPHAN_SOURCE' AS issue, node_id FROM n WHERE kind = 'source' AND node_id NOT IN (SELECT src FROM e)
UNION ALL SELECT 0, 'ERROR', 'UNREACHABLE', node_id FROM n WHERE kind = 'derived' AND node_id NOT IN (SELECT dst FROM e WHERE src IN (SELECT node_id FROM n))
UNION ALL SELECT 0, 'ERROR', 'MISSING_NODE', dst FROM e WHERE src NOT IN (SELECT node_id FROM n))
SELECT rank, severity, issue, count(*) AS n, (SELECT count(*) = 0 FROM i WHERE severity = 'ERROR') AS healthy FROM i GROUP BY rank, severity, issue"""
)
def integrity_summary(spark, sf_dir):
    issues = cut(integrity_check_all(spark, sf_dir))
    return G.issue_summary(issues).withColumn("healthy", F.lit(G.is_healthy(issues)))
