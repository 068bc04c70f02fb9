"""A spreadsheet, a build, a dashboard, an optimised computation, and an ETL of three graphs."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.graph import Blueprint
from millrace.operators import streams
from millrace.plans import federation, optimize
from millrace.plans.engine import Workbench
from millrace.plans.evaluate import evaluate
from millrace.plans.history import replay
from millrace.streaming.channel import Channel, Subscriptions


def sheet() -> Blueprint:
    """Price, tax and quantity to subtotal, tax and total."""
    g = Blueprint()
    for s in ("price", "tax_rate", "quantity"):
        g.source(s)
    g.derive("subtotal", lambda c: c["price"] * c["quantity"], ["price", "quantity"])
    g.derive("unit_tax", lambda c: c["price"] * c["tax_rate"], ["price", "tax_rate"])
    g.derive("total", lambda c: c["subtotal"] + c["unit_tax"] * c["quantity"], ["subtotal", "unit_tax", "quantity"])
    return g


def recalculate(spark: SparkSession, cells: Mapping[str, float]) -> dict[str, float]:
    row = evaluate(spark.createDataFrame([dict(cells)]), sheet()).first()
    return row.asDict()


def build(sources: list[str], target: str) -> Blueprint:
    """Each source file to an object, all objects to a target; files are tables of their lines."""
    g = Blueprint()
    for s in sources:
        g.source(s)
        g.derive(s.replace(".c", ".o"), lambda t, s=s: t[s].where("line not like '//%'").select(F.upper("line").alias("line")), [s])
    objects = [s.replace(".c", ".o") for s in sources]
    g.derive(target, lambda t: t[objects[0]] if len(objects) == 1 else _stacked([t[o] for o in objects]), objects)
    return g


def _stacked(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


class Build:
    """Rebuilds what changed; a change of comments alone leaves the target alone."""

    def __init__(self, spark: SparkSession, sources: list[str], target: str) -> None:
        self.spark, self.target, self.bench = spark, target, Workbench(build(sources, target))

    def edit(self, name: str, *lines: str) -> None:
        self.bench.set(name, self.spark.createDataFrame([(x,) for x in lines], "line string"))

    def run(self) -> list[str]:
        """The names of what was built anew."""
        self.bench.demand(self.target)
        return self.bench.report.evaluated


class Dashboard:
    """Widgets show the last value of their nodes, by groups that can be paused."""

    def __init__(self) -> None:
        self.channel, self.subscriptions, self.shown = Channel(), Subscriptions(), {}

    def widget(self, name: str, node: str, group: str) -> None:
        self.channel.observe(node)
        self.subscriptions.subscribe(self.channel, lambda e: self.shown.__setitem__(name, e.value), group, lambda e: e.node == node)

    def follow(self, log: DataFrame, graph: Blueprint, keys: list[str], order: list[str]) -> Any:
        changes = replay(log, graph, keys, order).recomputed().orderBy(*order)
        return self.channel.emit_rows(changes)

    @staticmethod
    def board(alerts: DataFrame, sales: DataFrame, keys: list[str], order: list[str], source: str, value: str) -> DataFrame:
        """Two streams on one board: what came last on each, at every event once both have spoken."""
        both = streams.merge(alerts.withColumn(source, F.lit("alert")), sales.withColumn(source, F.lit("sale")))
        return streams.combine_latest(both, keys, order, source, value, ["alert", "sale"])


def revenue() -> Blueprint:
    """Sales less returns, tax and discount, in hundredths and per mille; with a chain, a diamond and a dead branch."""
    g = Blueprint()
    for s in ("sales", "returned", "tax", "discount", "legacy"):
        g.source(s)
    g.derive("clean", lambda c: F.greatest(c["sales"], F.lit(0).cast("long")), ["sales"])
    g.derive("inflated", lambda c: c["clean"] * 1020, ["clean"])
    g.derive("rounded", lambda c: F.floor(c["inflated"] / 1000), ["inflated"])
    g.derive("net", lambda c: c["rounded"] - c["returned"], ["rounded", "returned"])
    g.derive("taxed", lambda c: c["net"] * c["tax"], ["net", "tax"])
    g.derive("rebate", lambda c: c["net"] * c["discount"], ["net", "discount"])
    g.derive("final", lambda c: c["net"] * 100 - c["taxed"] - c["rebate"], ["net", "taxed", "rebate"])
    g.derive("metric", lambda c: c["legacy"] * 42, ["legacy"])
    g.derive("more_metric", lambda c: c["metric"] + 100, ["metric"])
    return g


def optimised(graph: Blueprint, outputs: list[str]) -> tuple[Blueprint, dict[str, Any]]:
    """The blueprint without what the outputs do not need, chains fused, and what that is worth."""
    lean = optimize.prune(graph, outputs)
    chains = optimize.fusable(lean, outputs)
    fused = optimize.fuse(lean, chains, outputs)
    before, after = optimize.CostModel(graph).profile(), optimize.CostModel(fused).profile()
    return fused, {
        "nodes": (len(graph), len(lean), len(fused)),
        "pruned": sorted(optimize.dead(graph, outputs)),
        "fused": [c.nodes for c in chains],
        "saved": sum(c.saving for c in chains),
        "cost": (before["total"], after["total"]),
        "speedup": optimize.partition(fused).speedup,
        "shape": optimize.shape(fused),
        "impact": {s: optimize.impact_of(fused, [s]).share for s in fused.sources},
    }


class Etl:
    """Extract, transform and load as graphs of their own, in one federation, with clocks of who wrote when."""

    def __init__(self) -> None:
        extract, transform, load = Blueprint(), Blueprint(), Blueprint()
        for s in ("income", "spending", "heads"):
            extract.source(s)
        extract.derive("revenue", lambda c: F.greatest(c["income"], F.lit(0).cast("long")), ["income"])
        extract.derive("costs", lambda c: F.abs(c["spending"]), ["spending"])
        for s in ("revenue", "costs", "heads"):
            transform.source(s)
        transform.derive("profit", lambda c: c["revenue"] - c["costs"], ["revenue", "costs"])
        transform.derive("per_head", lambda c: F.expr("try_divide(`transform::revenue`, `transform::heads`)").cast("long"), ["revenue", "heads"])
        for s in ("profit", "per_head"):
            load.source(s)
        load.derive("health", lambda c: F.when(c["profit"] > 0, c["per_head"]).otherwise(0), ["profit", "per_head"])
        self.federation, self.book = federation.Federation(), federation.SyncBook()
        for name, graph in (("extract", extract), ("transform", transform), ("load", load)):
            self.federation.register(name, graph)
            self.book.register(name)
        self.federation.bridge("extract", "revenue", "transform", "revenue")
        self.federation.bridge("extract", "costs", "transform", "costs")
        self.federation.bridge("extract", "heads", "transform", "heads")
        self.federation.bridge("transform", "profit", "load", "profit")
        self.federation.bridge("transform", "per_head", "load", "per_head")

    def ingest(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys, profit, health`` for ``rows(keys, income, spending, heads)``; each graph is noted as written and synced."""
        names = ("extract", "transform", "load")
        for name in names:
            self.book.record(name, "rows")
        bind = {f"extract::{s}": F.col(s) for s in ("income", "spending", "heads")}
        out = evaluate(rows, self.federation.merged(), ["load::profit", "load::health"], bind=bind)
        for a, b in zip(names, names[1:], strict=False):
            self.book.synchronize(a, b, [])
        return out.select(*keys, F.col("`load::profit`").alias("profit"), F.col("`load::health`").alias("health"))

    def status(self) -> dict[str, str]:
        return {f"{a} to {b}": self.book.state(a, b) for a, b in (("extract", "transform"), ("transform", "load"))}

    @staticmethod
    def settle(conflicts: DataFrame) -> DataFrame:
        """Writes of one row by two graphs: the last writer wins, but of profits the lower one does."""
        return federation.resolve_conflicts(conflicts, merge=None, merges={"profit": F.least}, default="merge")
