"""A blueprint: named sources and derived nodes in a directed acyclic graph, held by the driver.

A derived node has a builder, a function from its parents' columns (or DataFrames) to its own. Builders
are called while a query is planned, never per row, so Catalyst sees plain expressions.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[Mapping[str, Any]], Any]


class CycleError(ValueError):
    """An edge would close a cycle."""


@dataclass(frozen=True)
class Node:
    name: str
    parents: tuple[str, ...] = ()
    build: Builder | None = None
    priority: int = 0
    #: Whether the node looks at more than its own row (windows); such nodes are never fused away.
    stateful: bool = False
    #: Name under which the builder is registered, for storing blueprints.
    label: str | None = None

    @property
    def is_source(self) -> bool:
        return self.build is None


class Blueprint:
    def __init__(self) -> None:
        self._nodes: dict[str, Node] = {}
        self._children: dict[str, list[str]] = {}

    # --- building ---------------------------------------------------------------------------

    def source(self, name: str) -> Node:
        return self._add(Node(name))

    def derive(self, name: str, build: Builder, parents: Iterable[str], *, priority: int = 0, stateful: bool = False, label: str | None = None) -> Node:
        """Add a node over existing parents; a parent named twice counts as one edge."""
        parents = tuple(dict.fromkeys(parents))
        for p in parents:
            if p not in self._nodes:
                raise ValueError(f"{name}: unknown parent {p}")
        return self._add(Node(name, parents, build, priority, stateful, label))

    def _add(self, node: Node) -> Node:
        if node.name in self._nodes:
            raise ValueError(f"{node.name} exists already")
        self._nodes[node.name] = node
        self._children[node.name] = []
        for p in node.parents:
            self._children[p].append(node.name)
        return node

    def link(self, parent: str, child: str) -> None:
        """Make ``parent`` one more parent of ``child``; nothing happens if it is one."""
        for name in (parent, child):
            if name not in self._nodes:
                raise ValueError(f"unknown node {name}")
        if self._nodes[child].is_source:
            raise ValueError(f"{child} is a source and has no parents")
        if parent == child or self.reaches(child, parent):
            raise CycleError(f"{parent} -> {child} closes a cycle")
        if parent not in self._nodes[child].parents:
            self._nodes[child] = replace(self._nodes[child], parents=(*self._nodes[child].parents, parent))
            self._children[parent].append(child)

    def remove(self, name: str) -> None:
        """Drop a node and its edges; children go on without it."""
        node = self.node(name)
        for p in node.parents:
            self._children[p].remove(name)
        for c in self._children.pop(name):
            self._nodes[c] = replace(self._nodes[c], parents=tuple(p for p in self._nodes[c].parents if p != name))
        del self._nodes[name]

    def rebuilt(self, nodes: Iterable[Node]) -> Blueprint:
        """A blueprint of these nodes, parents first."""
        out, left = Blueprint(), {n.name: n for n in nodes}
        while left:
            ready = [n for n in left.values() if all(p in out._nodes for p in n.parents)]
            if not ready:
                raise CycleError(f"no order for {sorted(left)}")
            for n in ready:
                out._add(left.pop(n.name))
        return out

    def copy(self) -> Blueprint:
        return self.rebuilt(self._nodes.values())

    # --- looking ----------------------------------------------------------------------------

    def node(self, name: str) -> Node:
        return self._nodes[name]

    def __contains__(self, name: object) -> bool:
        return name in self._nodes

    def __len__(self) -> int:
        return len(self._nodes)

    @property
    def names(self) -> list[str]:
        return list(self._nodes)

    @property
    def sources(self) -> list[str]:
        return [n.name for n in self._nodes.values() if n.is_source]

    @property
    def derived(self) -> list[str]:
        return [n.name for n in self._nodes.values() if not n.is_source]

    def parents(self, name: str) -> tuple[str, ...]:
        return self._nodes[name].parents

    def children(self, name: str) -> list[str]:
        return sorted(self._children[name])

    def _closure(self, start: Iterable[str], step: Callable[[str], Iterable[str]]) -> set[str]:
        seen: set[str] = set()
        todo = list(start)
        while todo:
            for n in step(todo.pop()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def downstream(self, *names: str) -> set[str]:
        """Everything that depends on the nodes, themselves excluded unless they depend on one another."""
        return self._closure([self.node(n).name for n in names], lambda n: self._children[n])

    def upstream(self, *names: str) -> set[str]:
        return self._closure([self.node(n).name for n in names], self.parents)

    def reaches(self, start: str, end: str) -> bool:
        return end in self.downstream(start)

    def stale_after(self, changed: Iterable[str], seen: Mapping[str, Mapping[str, int]], now: Mapping[str, int]) -> set[str]:
        """Derived nodes reached from ``changed`` along edges whose parent's generation has passed the one last seen."""
        step = lambda n: [c for c in self._children[n] if now.get(n, 0) > seen.get(c, {}).get(n, 0)]
        return self._closure(changed, step)

    def schedule(self, names: Iterable[str] | None = None) -> list[str]:
        """The derived nodes among ``names`` with parents before children, ties by (priority, name)."""
        chosen = {n for n in (self._nodes if names is None else names) if n in self._nodes and not self._nodes[n].is_source}
        waiting = {n: sum(p in chosen for p in self.parents(n)) for n in chosen}
        ready = [(self._nodes[n].priority, n) for n, k in waiting.items() if not k]
        heapq.heapify(ready)
        out = []
        while ready:
            _, n = heapq.heappop(ready)
            out.append(n)
            for c in self._children[n]:
                if c in waiting:
                    waiting[c] -= 1
                    if not waiting[c]:
                        heapq.heappush(ready, (self._nodes[c].priority, c))
        return out

    def levels(self) -> dict[str, int]:
        """Longest distance from a source: sources have 0."""
        out = {n: 0 for n in self._nodes}
        for n in self.schedule():
            out[n] = 1 + max((out[p] for p in self.parents(n)), default=0)
        return out

    def restricted(self, outputs: Iterable[str]) -> Blueprint:
        """Only what the outputs need."""
        outputs = list(outputs)
        keep = self.upstream(*outputs) | set(outputs)
        return self.rebuilt(n for n in self._nodes.values() if n.name in keep)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The catalogue as ``nodes(node_id, kind, priority)`` and ``edges(src, dst)``."""
        nodes = [(n.name, "source" if n.is_source else "derived", n.priority) for n in self._nodes.values()]
        edges = [(p, n.name) for n in self._nodes.values() for p in n.parents]
        return (
            spark.createDataFrame(nodes, "node_id string, kind string, priority int"),
            spark.createDataFrame(edges, "src string, dst string"),
        )
