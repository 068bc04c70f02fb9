"""A workbench of DataFrames: nodes are tables, and only what is stale is computed again.

A node's memo is keyed by the fingerprints of its parents. A fingerprint takes a table as a multiset of
rows, so a parent that was recomputed to the same rows leaves its children alone: early cutoff between
tables. Results are kept in the checkpoint folder, where lost executors do not take them along.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.lineage import cut
from millrace.graph.blueprint import Blueprint
from millrace.plans.hooks import HookBoard, Moment

Fingerprint = tuple[Any, ...]


def fingerprint(df: DataFrame) -> Fingerprint:
    """The table as a multiset of rows: schema, count, xor and sum of row hashes. One aggregate with a partial step."""
    cols = [F.array_sort(F.map_entries(c.name)) if isinstance(c.dataType, T.MapType) else F.col(f"`{c.name}`") for c in df.schema.fields]
    h = F.xxhash64(*cols) if cols else F.lit(0).cast("long")
    # xor alone would not see rows that come in pairs
    row = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return (df.schema.simpleString(), row["n"], row["x"], int(row["s"] or 0))


@dataclass
class Memo:
    table: DataFrame
    fingerprint: Fingerprint
    generation: int
    #: Parents' fingerprints and generations when this was computed.
    seen: dict[str, tuple[Fingerprint, int]]
    seconds: float = 0.0


@dataclass
class Report:
    """What a demand did: nodes built anew, those of them that changed, those that did not, and those reused."""

    evaluated: list[str] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)
    cut_off: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)


class TransactionError(RuntimeError):
    """A transaction was used out of turn."""


class Checkpoint:
    """The tables, fingerprints and generations that a workbench had; they can be put back any number of times, until discarded."""

    def __init__(self, bench: Workbench) -> None:
        self._bench = bench
        self._held: tuple[dict[str, Memo], dict[str, int]] | None = bench._held()

    def restore(self) -> None:
        if self._held is None:
            raise RuntimeError("the checkpoint was discarded")
        memo, generations = self._held
        self._bench._memo = {k: replace(m, seen=dict(m.seen)) for k, m in memo.items()}
        self._bench._last_generation = dict(generations)

    def discard(self) -> None:
        self._held = None


class Workbench:
    """Sources hold tables; derived nodes are functions from a mapping of parents' tables to a table."""

    def __init__(self, graph: Blueprint, hooks: HookBoard | None = None) -> None:
        self.graph, self.hooks = graph, hooks or HookBoard()
        self._memo: dict[str, Memo] = {}
        self._last_generation: dict[str, int] = {}
        self._pending: dict[str, DataFrame] | None = None
        self.report = Report()
        #: How often each node was computed, and the seconds that took, over all demands.
        self.invocations: dict[str, int] = {}
        self.spent: dict[str, float] = {}

    # --- sources ----------------------------------------------------------------------------

    def set(self, name: str, table: DataFrame) -> int:
        """Give a source its table; its generation grows only if the rows differ. In a transaction it waits for the commit."""
        if not self.graph.node(name).is_source:
            raise ValueError(f"{name} is not a source")
        if self._pending is not None:
            self._pending[name] = table
            return self.generation(name)
        return self._store(name, table, {}, 0.0)

    def _store(self, name: str, table: DataFrame, seen: dict, seconds: float) -> int:
        mark = fingerprint(table)
        old = self._memo.get(name)
        generation = self._last_generation.get(name, 0)
        if old is not None and old.fingerprint == mark:
            old.seen = seen
            return generation
        self._last_generation[name] = generation = generation + 1
        self._memo[name] = Memo(table, mark, generation, seen, seconds)
        return generation

    # --- demand -----------------------------------------------------------------------------

    def demand(self, *names: str) -> dict[str, DataFrame]:
        """Tables of the nodes, computing what is stale among their ancestors, each once."""
        self.report = Report()
        needed = self.graph.upstream(*names) | set(names)
        for s in needed:
            if self.graph.node(s).is_source and s not in self._memo:
                raise LookupError(f"source {s} has no table")
        self.hooks.fire(Moment("before_propagate", None, {"names": names}))
        for name in self.graph.schedule(needed):
            self._refresh(name)
        self.hooks.fire(Moment("after_propagate", None, {"report": self.report}))
        return {n: self._memo[n].table for n in names if n in self._memo}

    def _refresh(self, name: str) -> None:
        node, memo = self.graph.node(name), self._memo.get(name)
        now = {p: (self._memo[p].fingerprint, self._memo[p].generation) for p in node.parents}
        if memo is not None and {p: f for p, (f, _) in memo.seen.items()} == {p: f for p, (f, _) in now.items()}:
            self.report.reused.append(name)
            return
        moment = self.hooks.fire(Moment("before_evaluate", name))
        if moment.cancelled:
            if memo is None:
                raise LookupError(f"{name} was cancelled and has no earlier table")
            return
        began = time.perf_counter()
        try:
            table = cut(node.build({p: self._memo[p].table for p in node.parents}))
        except Exception as e:
            self.hooks.fire(Moment("error", name, {"error": e}))
            raise
        seconds = time.perf_counter() - began
        before = self._last_generation.get(name, 0)
        after = self._store(name, table, now, seconds)
        self.report.evaluated.append(name)
        self.report.seconds[name] = seconds
        self.invocations[name] = self.invocations.get(name, 0) + 1
        self.spent[name] = self.spent.get(name, 0.0) + seconds
        (self.report.changed if after > before else self.report.cut_off).append(name)
        self.hooks.fire(Moment("after_evaluate" if after > before else "cut_off", name, {"seconds": seconds, "generation": after}))

    def propagate(self, *changed: str) -> Report:
        """Bring everything below the sources up to date."""
        below = sorted(self.graph.downstream(*changed))
        if below:
            self.demand(*below)
        return self.report

    # --- memo -------------------------------------------------------------------------------

    def generation(self, name: str) -> int:
        return self._last_generation.get(name, 0)

    def is_valid(self, name: str) -> bool:
        memo = self._memo.get(name)
        if memo is None:
            return False
        parents = self.graph.parents(name)
        fits = all(p in self._memo and memo.seen.get(p, (None,))[0] == self._memo[p].fingerprint for p in parents)
        return fits and all(self.graph.node(p).is_source or self.is_valid(p) for p in parents)

    def memo(self, name: str) -> DataFrame | None:
        """The table as it is kept, stale or not; nothing is computed."""
        memo = self._memo.get(name)
        return None if memo is None else memo.table

    def seen(self, name: str) -> dict[str, int]:
        """The generations of the parents that the kept table was computed from."""
        memo = self._memo.get(name)
        return {} if memo is None else {p: g for p, (_, g) in memo.seen.items()}

    def states(self) -> dict[str, str]:
        """CLEAN where the kept table may be used, else DIRTY."""
        return {n: "CLEAN" if self.is_valid(n) else "DIRTY" for n in self.graph.names}

    def evict(self, name: str) -> bool:
        """Forget a table; its generation is not forgotten."""
        return self._memo.pop(name, None) is not None

    def clear(self) -> None:
        self._memo = {k: m for k, m in self._memo.items() if self.graph.node(k).is_source}

    def __len__(self) -> int:
        return len(self._memo)

    # --- checkpoints ------------------------------------------------------------------------

    def _held(self) -> tuple[dict[str, Memo], dict[str, int]]:
        return {k: replace(m, seen=dict(m.seen)) for k, m in self._memo.items()}, dict(self._last_generation)

    def checkpoint(self) -> Checkpoint:
        return Checkpoint(self)

    # --- transactions -----------------------------------------------------------------------

    @contextlib.contextmanager
    def transaction(self, *watch: str) -> Iterator[Workbench]:
        """Sources set inside count together at the end, with one propagation to ``watch``; an exception takes all back."""
        if self._pending is not None:
            raise TransactionError("a transaction is open already")
        before = self.checkpoint()
        self._pending = {}
        try:
            yield self
            pending, self._pending = self._pending, None
            for name, table in pending.items():
                self.set(name, table)
            if watch:
                self.demand(*watch)
        except BaseException:
            before.restore()
            raise
        finally:
            self._pending = None

    def hotspots(self, top: int = 5) -> list[tuple[str, float]]:
        """Nodes by the seconds that computing them took in all."""
        return sorted(self.spent.items(), key=lambda x: (-x[1], x[0]))[:top]

    def profile(self, *names: str) -> dict[str, dict[str, float]]:
        """Demand the nodes; for each one computed by that: how often it has been, and its seconds now and in all."""
        self.demand(*names)
        return {n: {"count": self.invocations[n], "seconds": self.report.seconds[n], "total": self.spent[n]} for n in self.report.evaluated}

    @property
    def total_seconds(self) -> float:
        return sum(self.spent.values())
