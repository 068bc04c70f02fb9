"""Replay of an append-only change log through a blueprint, as window functions.

A log has one row for each change of one source: keys, an order, the source's name and its value. For
each row the known value of every source is carried forward; the blueprint is evaluated on that; and
comparing with the row before tells what the incremental engine would do:

* a node is *evaluated* where a direct parent changed,
* *changed* where its value then differs (null-safe) from the row before,
* *cut off* where it was evaluated without changing, so nothing below it need be looked at,
* and its *generation* counts its changes so far.

All windows share one partitioning and order: a replay costs one exchange and one sort.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import differs
from millrace.graph.blueprint import Blueprint
from millrace.plans.evaluate import evaluate


@dataclass
class History:
    """A replayed log: one row a change, with ``<node>``, ``<node>__evaluated``, ``__changed``, ``__generation``."""

    frame: DataFrame
    graph: Blueprint
    keys: list[str]
    order: list[str]

    @property
    def nodes(self) -> list[str]:
        return self.graph.names

    def _long(self, fields: dict[str, str], nodes: Iterable[str] | None = None) -> DataFrame:
        """A row for each log row and node. Values are given as doubles."""
        each = [
            F.struct(
                F.lit(n).alias("node_id"), F.col(n).cast("double").alias("value"), F.col(f"{n}__old").cast("double").alias("old_value"), *[F.col(f"{n}__{f}").alias(to) for f, to in fields.items()]
            )
            for n in (self.nodes if nodes is None else nodes)
        ]
        return self.frame.select(*self.keys, *self.order, F.explode(F.array(*each)).alias("e")).select(*self.keys, *self.order, "e.*")

    def recomputed(self, nodes: Iterable[str] | None = None) -> DataFrame:
        """Derived nodes that took a new value: what a propagation reports."""
        nodes = self.graph.derived if nodes is None else nodes
        return self._long({"changed": "changed", "generation": "generation"}, nodes).where("changed").drop("changed")

    def cut_off(self, nodes: Iterable[str] | None = None) -> DataFrame:
        nodes = self.graph.derived if nodes is None else nodes
        rows = self._long({"evaluated": "evaluated", "changed": "changed"}, nodes)
        return rows.where(F.col("evaluated") & ~F.col("changed")).drop("evaluated", "changed", "old_value")

    def trace(self, nodes: Iterable[str] | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
        """The events of each propagation: source changes, invalidations, evaluations and cutoffs, in order.

        ``nodes`` and ``kinds`` name what is recorded; events of other nodes and kinds are not even made.
        """
        kinds = {"SOURCE_CHANGED", "INVALIDATED", "COMPUTED", "CUT_OFF"} if kinds is None else set(kinds)
        chosen = set(self.nodes if nodes is None else nodes)
        order = {n: i for i, n in enumerate([*self.graph.sources, *self.graph.schedule()])}
        events = []
        for n in self.nodes:
            if n not in chosen:
                continue
            at = F.lit(order[n]).alias("position")
            if self.graph.node(n).is_source:
                if "SOURCE_CHANGED" in kinds:
                    events.append(F.when(F.col(f"{n}__changed"), F.struct(F.lit("SOURCE_CHANGED").alias("event"), F.lit(n).alias("node_id"), at)))
                continue
            if "INVALIDATED" in kinds:
                touched = functools.reduce(lambda a, b: a | b, [F.col(f"{s}__changed") for s in self.graph.sources if self.graph.reaches(s, n)], F.lit(False))
                events.append(F.when(touched, F.struct(F.lit("INVALIDATED").alias("event"), F.lit(n).alias("node_id"), at)))
            kind = F.when(F.col(f"{n}__changed"), "COMPUTED").otherwise("CUT_OFF")
            if {"COMPUTED", "CUT_OFF"} & kinds:
                events.append(F.when(F.col(f"{n}__evaluated") & kind.isin(sorted(kinds)), F.struct(kind.alias("event"), F.lit(n).alias("node_id"), at)))
        if not events:
            none = F.struct(F.lit("").alias("event"), F.lit("").alias("node_id"), F.lit(0).alias("position"))
            events = [F.when(F.lit(False), none)]
        listed = F.filter(F.array(*events), lambda e: e.isNotNull())
        return self.frame.select(*self.keys, *self.order, F.explode(listed).alias("e")).select(*self.keys, *self.order, "e.*")

    def as_of(self, until: Column | None = None) -> DataFrame:
        """Per key the state after its last row that satisfies ``until``: ``value``, ``generation`` of every node."""
        rows = self.frame if until is None else self.frame.where(until)
        fields = [f for n in self.nodes for f in (n, f"{n}__generation")]
        last = F.max_by(F.struct(*fields), F.struct(*self.order))
        return rows.groupBy(*self.keys).agg(last.alias("s")).select(*self.keys, "s.*")

    def snapshot(self, until: Column | None = None) -> DataFrame:
        """``as_of`` as rows: keys, node_id, is_input, value, generation."""
        state = self.as_of(until)
        each = [
            F.struct(F.lit(n).alias("node_id"), F.lit(self.graph.node(n).is_source).alias("is_input"), F.col(n).cast("double").alias("value"), F.col(f"{n}__generation").alias("generation"))
            for n in self.nodes
        ]
        return state.select(*self.keys, F.explode(F.array(*each)).alias("e")).select(*self.keys, "e.*")


def carry_forward(log: DataFrame, sources: Sequence[str], keys: Sequence[str], order: Sequence[str], name: str = "input", value: str = "value") -> DataFrame:
    """The log with a column for each source: its last known value. Nulls that were set count as values."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = {s: F.last(F.when(F.col(name) == s, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)["v"] for s in sources}
    return log.withColumns(known)


def replay(log: DataFrame, graph: Blueprint, keys: Sequence[str], order: Sequence[str], name: str = "input", value: str = "value") -> History:
    """Replay ``log`` through ``graph``. Derived nodes are null until all they need is known, unless they say otherwise."""
    keys, order = list(keys), list(order)
    slim = log.where(F.col(name).isin(graph.sources)).select(*keys, *order, name, value)
    state = evaluate(carry_forward(slim, graph.sources, keys, order, name, value), graph, keep=[*keys, *order, name])
    w = Window.partitionBy(*keys).orderBy(*order)
    old = {f"{n}__old": F.lag(n).over(w) for n in graph.names}
    state = state.withColumns(old)
    changed = {f"{n}__changed": differs(F.col(n), F.col(f"{n}__old")) for n in graph.names}
    state = state.withColumns(changed)
    evaluated = {}
    for n in graph.names:
        tests = [F.col(f"{p}__changed") for p in graph.parents(n)]
        evaluated[f"{n}__evaluated"] = functools.reduce(lambda a, b: a | b, tests) if tests else F.col(name) == n
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    generation = {f"{n}__generation": F.sum(F.col(f"{n}__changed").cast("long")).over(upto) for n in graph.names}
    return History(state.withColumns(evaluated | generation), graph, keys, order)


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes whose value differs between two snapshots; a node missing on one side is null there."""
    on = [*keys, "node_id"]
    a = before.select(*on, F.col("value").alias("before"))
    b = after.select(*on, F.col("value").alias("after"))
    return a.join(b, on, "full").where(differs(F.col("before"), F.col("after")))


def diff_kinds(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every way in which a node differs between two snapshots: added, removed, value, generation, and state if both have one."""
    on = [*keys, "node_id"]
    state = F.col("state") if {"state"} <= set(before.columns) & set(after.columns) else F.lit(None)
    a = before.select(*on, F.col("value").alias("v0"), F.col("generation").alias("g0"), F.lit(True).alias("in0"), state.alias("s0"))
    b = after.select(*on, F.col("value").alias("v1"), F.col("generation").alias("g1"), F.lit(True).alias("in1"), state.alias("s1"))
    both = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    kinds = F.array(
        F.when(F.col("in0").isNull(), F.lit("NODE_ADDED")),
        F.when(F.col("in1").isNull(), F.lit("NODE_REMOVED")),
        F.when(both & differs(F.col("v0"), F.col("v1")), F.lit("VALUE_CHANGED")),
        F.when(both & differs(F.col("s0"), F.col("s1")), F.lit("STATE_CHANGED")),
        F.when(both & (F.col("g1") > F.col("g0")), F.lit("GENERATION_ADVANCED")),
    )
    return a.join(b, on, "full").select(*on, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("change"))


@dataclass
class Differences:
    """The rows of ``diff_kinds`` and what is asked of them."""

    rows: DataFrame

    def of(self, *kinds: str) -> DataFrame:
        return self.rows.where(F.col("change").isin(list(kinds)))

    def changed_nodes(self) -> DataFrame:
        """``node_id`` of the nodes that differ in any way."""
        return self.rows.select("node_id").distinct()

    def summary(self) -> DataFrame:
        """``change, n``: how many differences of each kind."""
        return self.rows.groupBy("change").agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.rows.count()

    def any(self) -> bool:
        return bool(self.rows.limit(1).count())
