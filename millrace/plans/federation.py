"""Several blueprints as one, vector clocks, synchronisation, and conflicting writes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.graph.blueprint import Blueprint, Node

SEP = "::"


def _under(space: str, node: Node) -> Node:
    build = node.build
    if build is not None:
        inner = build
        build = lambda c, inner=inner: inner({k.split(SEP, 1)[1]: v for k, v in c.items()})
    return Node(f"{space}{SEP}{node.name}", tuple(f"{space}{SEP}{p}" for p in node.parents), build, node.priority, node.stateful, node.label)


@dataclass
class Federation:
    """Named blueprints with edges from a node of one to a source of another.

    They run as one merged blueprint, so a graph that several others feed sees all their changes together.
    """

    graphs: dict[str, Blueprint] = field(default_factory=dict)
    bridges: dict[tuple[str, str], tuple[str, str, Callable[[Column], Column] | None]] = field(default_factory=dict)

    def register(self, space: str, graph: Blueprint) -> None:
        if space in self.graphs:
            raise ValueError(f"{space} exists already")
        self.graphs[space] = graph

    def unregister(self, space: str) -> bool:
        self.bridges = {k: v for k, v in self.bridges.items() if space not in (k[0], v[0])}
        return self.graphs.pop(space, None) is not None

    def bridge(self, source: str, node: str, target: str, into: str, transform: Callable[[Column], Column] | None = None) -> None:
        if source not in self.graphs or target not in self.graphs or source == target:
            raise ValueError("a bridge joins two registered graphs")
        if node not in self.graphs[source]:
            raise ValueError(f"unknown node {source}{SEP}{node}")
        if into not in self.graphs[target].sources:
            raise ValueError(f"{target}{SEP}{into} is not a source")
        self.bridges[target, into] = (source, node, transform)

    def endpoint(self, space: str) -> Blueprint:
        if space not in self.graphs:
            raise KeyError(f"no graph is called {space}")
        return self.graphs[space]

    def bridges_from(self, space: str) -> list[tuple[str, str]]:
        return sorted(k for k, v in self.bridges.items() if v[0] == space)

    def bridges_to(self, space: str) -> list[tuple[str, str]]:
        return sorted(k for k in self.bridges if k[0] == space)

    def merged(self) -> Blueprint:
        """One blueprint of all, nodes called ``space::name``; a bridged source becomes a derived node."""
        nodes = []
        for space, graph in self.graphs.items():
            for name in graph.names:
                node = _under(space, graph.node(name))
                if (space, name) in self.bridges:
                    source, of, transform = self.bridges[space, name]
                    parent = f"{source}{SEP}{of}"
                    fn = transform or (lambda c: c)
                    node = Node(node.name, (parent,), lambda c, parent=parent, fn=fn: fn(c[parent]))
                nodes.append(node)
        return Blueprint().rebuilt(nodes)


# --- vector clocks -------------------------------------------------------------------------------------------


def merged_clock(a: Column, b: Column) -> Column:
    """Component-wise maximum of two MAP<STRING, BIGINT> clocks."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))


def dominates(a: Column, b: Column) -> Column:
    """No component less, one greater; a missing component is 0."""
    zero = F.lit(0).cast("long")
    lead = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) - F.coalesce(y, zero)))
    return F.forall(lead, lambda d: d >= 0) & F.exists(lead, lambda d: d > 0)


def concurrent(a: Column, b: Column) -> Column:
    """Neither dominates; so equal clocks are concurrent too."""
    return ~dominates(a, b) & ~dominates(b, a)


def merged_clocks(clocks: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``keys..., clock`` of ``clocks(keys..., clock)``: the greatest of each component over all rows of a key."""
    keys = list(keys)
    parts = clocks.select(*keys, F.explode("clock").alias("graph", "at")).groupBy(*keys, "graph").agg(F.max("at").alias("at"))
    return parts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("graph", "at")))).alias("clock"))


def incremented(clock: Column, graph: Column) -> Column:
    """The clock with one more at a graph."""
    one = F.create_map(graph, F.coalesce(F.try_element_at(clock, graph), F.lit(0).cast("long")) + 1)
    return merged_clock(clock, one)


def sync_conflicts(mutations: DataFrame, syncs: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Nodes in conflict at each sync: the target wrote the same node after the pair's last sync.

    ``mutations(keys..., seq, graph, node)`` and ``syncs(keys..., seq, source, target, node)``, one row for each node
    synced. The window of a pair is its own: other pairs' syncs do not close it. Writes are counted along the
    order: those before a sync less those up to the pair's last one, so nothing is joined write by write.
    """
    from pyspark.sql.window import Window

    keys = list(keys)
    when = syncs.select(*keys, "source", "target", "seq").distinct()
    when = when.withColumn("since", F.lag("seq").over(Window.partitionBy(*keys, "source", "target").orderBy("seq")))
    s = syncs.distinct().join(when, [*keys, "source", "target", "seq"])
    row = F.struct("source", "seq")
    # at one number a probe for what was up to it comes after the writes, one for what was before it ahead of them
    probes = s.select(*keys, F.col("target").alias("graph"), "node", F.explode(F.array(
        F.struct(F.col("seq").alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("sign"), row.alias("row")),
        F.struct(F.col("since").alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("sign"), row.alias("row")),
    )).alias("p")).select(*keys, "graph", "node", "p.*").where("at is not null")
    none = F.lit(None).cast(probes.schema["row"].dataType)
    writes = mutations.select(*keys, "graph", "node", F.col("seq").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("sign"), none.alias("row"))
    along = Window.partitionBy(*keys, "graph", "node").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = writes.union(probes).withColumn("so_far", F.count(F.when(F.col("turn") == 1, 1)).over(along)).where("turn <> 1")
    total = counted.groupBy(*keys, "row", "graph", "node").agg(F.sum(F.col("sign") * F.col("so_far")).alias("writes")).where("writes > 0")
    return total.select(*keys, F.col("row.seq").alias("seq"), F.col("row.source").alias("source"), F.col("graph").alias("target"), "node", "writes")


@dataclass
class SyncBook:
    """Clocks of a few graphs on the driver, with the audit of each synchronisation."""

    clocks: dict[str, dict[str, int]] = field(default_factory=dict)
    writes: list[tuple[str, int, str]] = field(default_factory=list)
    last: dict[tuple[str, str], dict[str, int]] = field(default_factory=dict)

    def register(self, graph: str) -> None:
        self.clocks.setdefault(graph, {})

    def record(self, graph: str, node: str = "") -> int:
        self.register(graph)
        own = self.clocks[graph]
        own[graph] = own.get(graph, 0) + 1
        self.writes.append((graph, own[graph], node))
        return own[graph]

    @staticmethod
    def ahead(a: Mapping[str, int], b: Mapping[str, int]) -> bool:
        names = {*a, *b}
        return all(a.get(n, 0) >= b.get(n, 0) for n in names) and any(a.get(n, 0) > b.get(n, 0) for n in names)

    def _concurrent(self, a: str, b: str) -> bool:
        return not self.ahead(self.clocks[a], self.clocks[b]) and not self.ahead(self.clocks[b], self.clocks[a])

    def state(self, source: str, target: str) -> str:
        if source not in self.clocks or target not in self.clocks:
            return "UNKNOWN"
        seen = self.last.get((source, target))
        if seen is None:
            return "STALE"
        if seen.get(source, 0) == self.clocks[source].get(source, 0):
            return "IN_SYNC"
        return "DIVERGED" if self._concurrent(source, target) else "STALE"

    def synchronize(self, source: str, target: str, nodes: Iterable[str]) -> tuple[str, set[str], set[str]]:
        """The state afterwards, the nodes synced, and those in conflict."""
        nodes = set(nodes)
        if source not in self.clocks or target not in self.clocks:
            return "UNKNOWN", set(), set()
        conflicts: set[str] = set()
        if self._concurrent(source, target):
            since = self.last.get((source, target), {}).get(target, 0)
            conflicts = {n for g, at, n in self.writes if g == target and at > since and n in nodes}
        mine = self.clocks[target]
        for k, v in self.clocks[source].items():
            mine[k] = max(mine.get(k, 0), v)
        self.last[source, target] = dict(mine)
        return ("DIVERGED" if conflicts else "IN_SYNC"), nodes - conflicts, conflicts

    def mutation_count(self, graph: str) -> int:
        return sum(g == graph for g, _, _ in self.writes)


@dataclass
class Barrier:
    """Complete once all participants have arrived; others do not count."""

    participants: frozenset[str]
    arrived: set[str] = field(default_factory=set)

    def arrive(self, graph: str) -> bool:
        if graph in self.participants:
            self.arrived.add(graph)
        return self.complete

    @property
    def pending(self) -> set[str]:
        return set(self.participants) - self.arrived

    @property
    def complete(self) -> bool:
        return not self.pending


# --- conflicts -----------------------------------------------------------------------------------------------

POLICIES = ("last_writer", "first_writer", "highest", "lowest", "merge", "reject")


Merge = Callable[[Column, Column], Column]


def resolved(policy: Column, source: Column, target: Column, source_clock: Column, target_clock: Column, merge: Merge | None = None) -> Column:
    """The value that a conflict ends with. Ties go to the source; without a merge function the last writer wins."""
    later = F.when(source_clock >= target_clock, source).otherwise(target)
    return (
        F.when(policy == "reject", F.lit(None))
        .when(policy == "first_writer", F.when(source_clock <= target_clock, source).otherwise(target))
        .when(policy == "highest", F.when(target > source, target).otherwise(source))
        .when(policy == "lowest", F.when(target < source, target).otherwise(source))
        .when(policy == "merge", merge(source, target) if merge else later)
        .otherwise(later)
    )


def resolve_conflicts(conflicts: DataFrame, policies: DataFrame | None = None, default: str = "last_writer", merge: Merge | None = None, merges: Mapping[str, Merge] | None = None) -> DataFrame:
    """``conflicts(node, source_value, target_value, source_clock, target_clock)`` with ``policy``, ``value``, ``rejected``.

    ``merges`` has merge functions of single nodes; the others have ``merge``.
    """
    if policies is not None:
        conflicts = conflicts.join(policies, "node", "left").withColumn("policy", F.coalesce("policy", F.lit(default)))
    else:
        conflicts = conflicts.withColumn("policy", F.lit(default))
    columns = [F.col(c) for c in ("policy", "source_value", "target_value", "source_clock", "target_clock")]
    value = resolved(*columns, merge)
    for node, own in (merges or {}).items():
        value = F.when(F.col("node") == node, resolved(*columns, own)).otherwise(value)
    return conflicts.withColumn("value", value).withColumn("rejected", F.col("policy") == "reject")


def conflict_history(resolved_rows: DataFrame, order: str) -> DataFrame:
    """The resolved conflicts with ``turn``: the how-manyth of its node each is, from 1."""
    from pyspark.sql.window import Window

    return resolved_rows.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy(order)))


def frequent_conflicts(conflicts: DataFrame, least: int = 3) -> DataFrame:
    return conflicts.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def conflict_stats(resolved_rows: DataFrame) -> dict[str, Any]:
    rows = resolved_rows.groupBy("policy").agg(F.count("*").alias("n"), F.count_if("rejected").alias("rejected")).collect()
    return {r["policy"]: {"n": r["n"], "rejected": r["rejected"]} for r in rows}
