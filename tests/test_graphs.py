import math

import pytest

from millrace.graph import Blueprint
from millrace.plans import graphs as G


@pytest.fixture(scope="module")
def tables(spark):
    g = Blueprint()
    for s in "xyz":
        g.source(s)
    g.derive("a", lambda c: 0, ["x", "y"])
    g.derive("b", lambda c: 0, ["x"])
    g.derive("c", lambda c: 0, ["a", "b"])
    g.derive("d", lambda c: 0, ["z"])
    return g.tables(spark)


def names(df, col="node_id"):
    return {r[col] for r in df.collect()}


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "node_id string")


def test_reach_and_levels(spark, tables):
    nodes, edges = tables
    assert {(r.node_id, r.depth) for r in G.downstream(edges, ids(spark, "x")).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert names(G.upstream(edges, ids(spark, "c"))) == {"a", "b", "x", "y"}
    assert {r.node_id: r.level for r in G.levels(nodes, edges).collect()} == {"x": 0, "y": 0, "z": 0, "a": 1, "b": 1, "d": 1, "c": 2}
    ring = spark.createDataFrame([("p", "q"), ("q", "p")], "src string, dst string")
    with pytest.raises(ValueError):
        G.levels(ids(spark, "p", "q"), ring)
    assert names(G.reach(ring, ids(spark, "p"))) == {"p", "q"}


def test_impact(spark, tables):
    nodes, edges = tables
    seeds = ids(spark, "x", "y", "z").selectExpr("node_id as seed", "node_id")
    got = {r.seed: (r.affected, r.blast_radius, r.depth) for r in G.impact(nodes, edges, seeds, ("seed",)).collect()}
    assert got == {"x": (3, 0.75, 2), "y": (2, 0.5, 2), "z": (1, 0.25, 1)}
    assert {r.node_id: r.side for r in G.compare_impacts(edges, ids(spark, "x"), ids(spark, "y")).collect()} == {"a": "both", "b": "only_a", "c": "both"}
    assert names(G.shared_sources(nodes, edges, ids(spark, "a", "b"))) == {"x"}
    assert names(G.isolated_effects(edges, ids(spark, "x"))) == {"c"}
    assert {r.node_id: r.related for r in G.critical_nodes(nodes, edges, ids(spark, "a", "d")).collect()} == {}
    assert names(G.critical_nodes(nodes, edges, ids(spark, "c"))) == {"c"}


def test_patterns(spark, tables):
    nodes, edges = tables
    assert {(r.node_id, r.n_shared) for r in G.diamonds(edges).collect()} == {("c", 1)}
    chain = spark.createDataFrame([("s", "p"), ("p", "q"), ("q", "r"), ("s", "t")], "src string, dst string")
    every = ids(spark, "s", "p", "q", "r", "t")
    assert [(r["head"], r.n) for r in G.chains(every, chain).collect()] == [("p", 3)]
    fan = spark.createDataFrame([("s", f"k{i}") for i in range(4)], "src string, dst string")
    kids = ids(spark, "s", *[f"k{i}" for i in range(4)])
    assert [(r.node_id, r.severity) for r in G.fan_out_bottlenecks(kids, fan).collect()] == [("s", 0.4)]
    assert {r.kind for r in G.patterns(kids, fan).collect()} == {"FAN_OUT"}
    back = fan.selectExpr("dst as src", "src as dst")
    assert names(G.fan_in_aggregations(kids, back)) == {"s"}


def test_shape(spark, tables):
    nodes, edges = tables
    row = G.complexity(nodes, edges).first()
    assert (row.n_nodes, row.n_edges, row.depth, row.width, row.max_fan_in) == (7, 6, 3, 3, 2)
    assert row.density == pytest.approx(6 / 21)
    assert {(r.degree, r.n) for r in G.degree_distribution(nodes, edges).collect()} == {(0, 3), (1, 2), (2, 2)}
    assert {r.component for r in G.components(nodes, edges).collect()} == {"a", "d"}
    assert names(G.dead_nodes(nodes, edges, ids(spark, "c"))) == {"z", "d"}
    assert names(G.bottleneck_levels(nodes, edges)) == {"c"}
    assert G.cost_rank(nodes, edges).count() == 7


def test_integrity(spark, tables):
    nodes, edges = tables
    assert G.integrity(nodes, edges).count() == 0
    bad = nodes.where("node_id <> 'z'").union(spark.createDataFrame([("lone", "source", 0)], nodes.schema))
    got = {(r.issue, r.node_id) for r in G.integrity(bad, edges).collect()}
    assert got == {("ORPHAN_SOURCE", "lone"), ("UNREACHABLE", "d"), ("MISSING_NODE", "d")}
    states = spark.createDataFrame([("x", "CLEAN"), ("a", "DIRTY"), ("c", "CLEAN"), ("b", "CLEAN")], "node_id string, state string")
    assert names(G.stale_children(states, edges)) == {"c"}


def test_chains_over_all_orders(spark, tmp_path):
    """Order 5 alone would be a chain of three; order 7 has the same part and customer, so neither is."""
    import __spark_entry__ as entry

    lines, orders = [(1, 5), (1, 7), (2, 11)], [(5, 50), (7, 50), (11, 60)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r["head"], r.n) for r in entry.queries()["opt_chains"](spark, str(tmp_path)).collect()} == {("p:2", 3)}


def test_dead_nodes_of_open_orders(spark):
    """Every open order is an output, whatever its key."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    dead = names(entry.queries()["opt_dead_nodes"](spark, sf))
    orders = {f"o:{r.o_orderkey}": r.o_orderstatus for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    assert {k for k, v in orders.items() if v == "P"} == orders.keys() - dead


def test_diamonds_keep_the_share_of_a_task(spark, monkeypatch):
    """Thirty nodes below two of three parents each, one of them above another: more tasks where rows are more."""
    from millrace.functions import lineage

    monkeypatch.setattr(lineage, "SHARE", 10)
    pairs = [("top", "p"), ("top", "q"), ("p", "r")] + [(x, f"k{i}") for i in range(30) for x in ("pq" if i % 2 else "pr")]
    found = G.diamonds(spark.createDataFrame(pairs * 2, "src string, dst string"))
    assert {(r.node_id, r.n_shared) for r in found.collect()} == {(f"k{i}", 1 if i % 2 else 2) for i in range(30)}
    assert found.rdd.getNumPartitions() == 60 // 10 + 1


def test_sets_of_more_than_64_seeds(spark):
    """Every node below others is a seed: each reaches what is above it, at its distance."""
    pairs = [(f"{i:02}", f"{i + 1:02}") for i in (0, 1, 2, 66, 67)] + [("x", f"{i:02}") for i in range(66)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    seeds = edges.selectExpr("dst as of").distinct().selectExpr("of", "of as node_id")
    got = sorted((r.of, r.node_id, r.depth) for r in G.reach(edges, seeds, ("of",), reverse=True).collect())
    above = {}
    for a, b in pairs:
        above.setdefault(b, []).append(a)
    assert len(above) > 64
    want = []
    for s in above:
        depth, todo = {s: 0}, [s]
        for b in todo:
            new = [a for a in above.get(b, ()) if a not in depth]
            depth |= {a: depth[b] + 1 for a in new}
            todo += new
        want += [(s, k, d) for k, d in depth.items()]
    assert got == sorted(want)


def _wide(spark):
    """A root, two nodes below it, and thirty below both."""
    pairs = [("r", "a"), ("r", "b")] + [(x, f"k{i}") for i in range(30) for x in "ab"]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    kinds = [("r", "source")] + [(x, "derived") for x in ("a", "b", *(f"k{i}" for i in range(30)))]
    return spark.createDataFrame(kinds, "node_id string, kind string"), edges


def test_levels_keep_the_share_of_a_task(spark, monkeypatch):
    from millrace.functions import lineage

    monkeypatch.setattr(lineage, "SHARE", 10)
    nodes, edges = _wide(spark)
    found = G.levels(nodes, edges.union(edges))
    assert {r.node_id: r.level for r in found.collect()} == {"r": 0, "a": 1, "b": 1} | {f"k{i}": 2 for i in range(30)}
    assert found.rdd.getNumPartitions() > 62 // 10
    row = G.complexity(nodes, edges).first()
    assert (row.n_edges, row.width, row.max_fan_out) == (62, 30, 30) and row.entropy == pytest.approx(-sum(f / 62 * math.log2(f / 62) for f in (2, 30, 30)))


def test_critical_nodes_by_counts_of_sets(spark):
    nodes, edges = _wide(spark)
    seeds = nodes.where("kind = 'derived'").selectExpr("node_id as of", "node_id")
    assert {(r.of, r.depth, r.n) for r in G.reach_counts(edges, seeds, ("of",)).collect()} == {("a", 1, 30), ("b", 1, 30)}
    assert {r.node_id: r.related for r in G.critical_nodes(nodes, edges, nodes.select("node_id"), 0.5).collect()} == {"r": 32, "a": 31, "b": 31}


def test_impact_counts_without_writing_pairs(spark, monkeypatch):
    nodes, edges = _wide(spark)
    monkeypatch.setattr(G, "reach", None)
    seeds = nodes.selectExpr("node_id as seed", "node_id")
    assert {r.seed: (r.affected, r.depth) for r in G.impact(nodes, edges, seeds, ("seed",)).collect()} == {"r": (32, 2), "a": (30, 1), "b": (30, 1)}


def test_distribution_counts_one_side(spark):
    nodes, edges = _wide(spark)
    found = G.degree_distribution(nodes, edges)
    assert {(r.degree, r.n) for r in found.collect()} == {(0, 1), (1, 2), (2, 30)}
    assert "fan_out" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("small, slots", [(30, 6), (12, 1)])
def test_levels_without_writing_all_edges(spark, monkeypatch, small, slots):
    """Edges may repeat and are not made distinct; upper ends are looked up by slots and one by one, or all in a join."""
    import random

    monkeypatch.setattr(G, "SMALL", small)
    monkeypatch.setattr(G, "SLOTS", slots)
    monkeypatch.setattr(G, "edge_table", None)
    r = random.Random(5)
    pairs = [(f"n{i:02}", f"n{j:02}") for i in range(60) for j in r.sample(range(i // 20 * 20 + 20, 70), 2)] + [(f"n{r.randrange(60):02}", f"k{i}") for i in range(99)]
    level = {f"n{i:02}": 0 for i in range(70)} | {"alone": 0}
    for a, b in sorted(pairs):
        level[b] = max(level.get(b, 0), level[a] + 1)
    nodes = ids(spark, *level)
    edges = spark.createDataFrame(pairs + pairs[::3], "src string, dst string")
    got = G.levels(nodes, edges).collect()
    assert len(got) == len(level) and {x.node_id: x.level for x in got} == level
    size = {v: list(level.values()).count(v) for v in level.values()}
    most = sorted(size.values())[1]
    assert names(G.bottleneck_levels(nodes, edges, most)) == {k for k, v in level.items() if size[v] <= most}
    for bad in (None, "n05"), ("ghost", "n69"):
        with pytest.raises(ValueError, match="cycle"):
            G.levels(nodes, edges.union(spark.createDataFrame([bad], "src string, dst string")))


def test_narrow_levels_bring_no_level_to_one_task(spark):
    nodes, edges = _wide(spark)
    found = G.bottleneck_levels(nodes, edges, 2)
    assert {(r.node_id, r.level) for r in found.collect()} == {("r", 0), ("a", 1), ("b", 1)}
    assert "Window" not in found._jdf.queryExecution().toString()
