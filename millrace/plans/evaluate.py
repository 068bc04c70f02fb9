"""Evaluation of a blueprint for every row of a table: one projection for each level of the graph."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.graph.blueprint import Blueprint


def evaluate(df: DataFrame, graph: Blueprint, outputs: Iterable[str] | None = None, bind: Mapping[str, Column] | None = None, keep: Iterable[str] | None = None) -> DataFrame:
    """``df`` with a column for each node that ``outputs`` (default: all) need.

    ``bind`` gives sources' columns; a source without one is the column of its name. ``keep`` names the
    columns of ``df`` to carry along (default: all). Nodes that no output needs are not built, and nodes on one
    level share a projection, which Catalyst merges with its neighbours as far as that pays.
    """
    wanted = list(graph.names if outputs is None else outputs)
    graph = graph.restricted(wanted)
    bind = dict(bind or {})
    kept = list(df.columns if keep is None else keep)
    levels = graph.levels()
    sources = [s for s in graph.sources if s in bind or s not in kept]
    df = df.select(*[F.col(c) for c in kept if c not in sources], *[bind.get(s, F.col(s)).alias(s) for s in sources])
    for level in range(1, max(levels.values(), default=0) + 1):
        nodes = [n for n in graph.schedule() if levels[n] == level]
        built = {n: graph.node(n).build({p: F.col(p) for p in graph.parents(n)}) for n in nodes}
        df = df.withColumns(built) if not set(nodes) & set(df.columns) else df.select(*[c for c in df.columns if c not in built], *[v.alias(k) for k, v in built.items()])
    return df.select(*[c for c in kept if c in df.columns and c not in wanted], *wanted)


def substituted(graph: Blueprint, output: str, bind: Mapping[str, Column]) -> Column:
    """The output as one expression over the sources, each node's expression put into its children's."""
    built: dict[str, Column] = dict(bind)
    for n in graph.schedule(graph.upstream(output) | {output}):
        built[n] = graph.node(n).build({p: built[p] for p in graph.parents(n)})
    return built[output]
