"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Every round takes the least label among a node and its neighbours, then that label's own label,
    so the number of rounds grows with the logarithm of a component's diameter. Labels and edges stay
    distributed; each round ends in a checkpoint, so lost executors repeat one round at most.
    Hubs are no hazard: the least label is an aggregate with a partial step before its exchange.
    """
    pairs = cut(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = cut(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        heard = (
            pairs.join(labels, pairs.b == labels.node)
            .groupBy("a")
            .agg(F.min("component").alias("heard"))
            .withColumnRenamed("a", "node")
        )
        lower = labels.join(heard, "node").select(
            "node", F.least("component", "heard").alias("near"), F.col("component").alias("old")
        )
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = cut(
            lower.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("component"), "old")
        )
        moved = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def merge_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels(node, component)`` after more ``edges(a, b)``: only components are compared, not their nodes again."""
    side = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"{k}_in"))
    named = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    named = cut(named.select("a", "b", F.coalesce("a_in", "a").alias("x"), F.coalesce("b_in", "b").alias("y")))
    merged = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    ends = named.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")), F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("e"))
    known = labels.union(ends.select("e.node", "e.component")).distinct()
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return cut(known.join(to, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
