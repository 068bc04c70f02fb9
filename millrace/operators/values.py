"""Map, filter, reduce, aggregates over named sources, and conditionals, as node builders.

Every function returns a builder for ``Blueprint.derive``: it takes the mapping of parents' columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import at_least, truthy
from millrace.graph.blueprint import Blueprint

Columns = Mapping[str, Column]
Builder = Callable[[Columns], Column]


def map_value(source: str, fn: Callable[[Column], Column]) -> Builder:
    return lambda c: fn(c[source])


def map_each(source: str, fn: Callable[[Column], Column]) -> Builder:
    """``fn`` on each element of an array."""
    return lambda c: F.transform(c[source], fn)


def map_chain(graph: Blueprint, names: Sequence[str], source: str, fns: Sequence[Callable[[Column], Column]]) -> None:
    """Add one node for each function, each on the one before; Catalyst folds them into one projection."""
    if len(names) != len(fns):
        raise ValueError("as many names as functions are needed")
    for name, fn in zip(names, fns, strict=True):
        graph.derive(name, map_value(source, fn), [source])
        source = name


def keep_if(source: str, test: Callable[[Column], Column]) -> Builder:
    """The value where the test holds, else null."""
    return lambda c: F.when(F.coalesce(test(c[source]), F.lit(False)), c[source])


def keep_each(source: str, test: Callable[[Column], Column]) -> Builder:
    return lambda c: F.filter(c[source], lambda x: F.coalesce(test(x), F.lit(False)))


def fold(source: str, merge: Callable[[Column, Column], Column], initial: Any = None) -> Builder:
    """Left fold over an array in its order. Without ``initial`` the first element starts, and so does the next after a null result."""

    def build(c: Columns) -> Column:
        items = c[source]
        if initial is not None:
            start = initial if isinstance(initial, Column) else F.lit(initial)
            return F.aggregate(items, start, lambda acc, x: F.when(acc.isNull(), x).otherwise(merge(acc, x)))
        first = F.try_element_at(items, F.lit(1))
        rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
        return F.aggregate(rest, first, lambda acc, x: F.when(acc.isNull(), x).otherwise(merge(acc, x)))

    return build


def fold_sources(sources: Sequence[str], merge: Callable[[Column, Column], Column], initial: Any = None) -> Builder:
    """Left fold across sources in the given order, put together while planning."""

    def build(c: Columns) -> Column:
        items = [c[s] for s in sources]
        if initial is not None:
            items = [F.lit(initial), *items]
        return functools.reduce(lambda acc, x: F.when(acc.isNull(), x).otherwise(merge(acc, x)), items)

    return build


# --- aggregates across sources; nulls do not count, and nothing but nulls gives null ---------------


def _known(c: Columns, sources: Sequence[str]) -> Column:
    return F.filter(F.array(*[c[s] for s in sources]), lambda x: x.isNotNull())


def total(sources: Sequence[str]) -> Builder:
    def build(c: Columns) -> Column:
        none = functools.reduce(lambda a, b: a & b, [c[s].isNull() for s in sources])
        zero = c[sources[0]] - c[sources[0]]
        zero = F.coalesce(zero, F.lit(0))
        return F.when(~none, functools.reduce(lambda a, b: a + b, [F.coalesce(c[s], zero) for s in sources]))

    return build


def count_known(sources: Sequence[str]) -> Builder:
    """How many sources are not null; null, not 0, if none is."""
    return lambda c: F.nullif(functools.reduce(lambda a, b: a + b, [c[s].isNotNull().cast("long") for s in sources]), F.lit(0).cast("long"))


def mean(sources: Sequence[str]) -> Builder:
    return lambda c: total(sources)(c).cast("double") / count_known(sources)(c)


def smallest(sources: Sequence[str]) -> Builder:
    return lambda c: F.least(*[c[s] for s in sources]) if len(sources) > 1 else c[sources[0]]


def largest(sources: Sequence[str]) -> Builder:
    return lambda c: F.greatest(*[c[s] for s in sources]) if len(sources) > 1 else c[sources[0]]


def product(sources: Sequence[str]) -> Builder:
    def build(c: Columns) -> Column:
        value = functools.reduce(lambda a, b: a * b, [F.coalesce(c[s].cast("double"), F.lit(1.0)) for s in sources])
        return F.when(count_known(sources)(c).isNotNull(), value)

    return build


def combine(sources: Sequence[str], fn: Callable[[list[Column]], Column]) -> Builder:
    """Any function of the sources' columns, nulls included."""
    return lambda c: fn([c[s] for s in sources])


def weighted(sources: Sequence[str], weights: Sequence[float]) -> Builder:
    """Weighted mean; a null adds nothing above, but its weight stays below the line. Weights adding up to 0 give 0."""
    if len(sources) != len(weights):
        raise ValueError("as many weights as sources are needed")
    below = float(sum(weights))

    def build(c: Columns) -> Column:
        if below == 0:
            return F.lit(0.0)
        above = [F.coalesce(c[s].cast("double"), F.lit(0.0)) * F.lit(float(w)) for s, w in zip(sources, weights, strict=True)]
        return functools.reduce(lambda a, b: a + b, above) / F.lit(below)

    return build


_AGGREGATES: dict[str, Callable[[Sequence[str]], Builder]] = {"sum": total, "average": mean, "min": smallest, "max": largest, "count": count_known, "product": product}


def aggregate(op: str, sources: Sequence[str], fn: Callable[[list[Column]], Column] | None = None, weights: Sequence[float] | None = None) -> Builder:
    """An aggregate across sources by its name; "custom" takes a function, "weighted" takes weights."""
    if not sources:
        raise ValueError("an aggregate needs a source at least")
    if op == "custom" and fn is not None:
        return combine(sources, fn)
    if op == "weighted" and weights is not None:
        return weighted(sources, weights)
    if op not in _AGGREGATES:
        raise ValueError(f"unknown aggregate {op}, or nothing given for it")
    return _AGGREGATES[op](sources)


# --- conditionals ----------------------------------------------------------------------------------


def choose(condition: str, then: str, otherwise: str, kind: T.DataType) -> Builder:
    """One of two nodes by the truth of a third, whose type says what counts as true."""
    return lambda c: F.when(truthy(c[condition], kind), c[then]).otherwise(c[otherwise])


def choose_if(source: str, test: Callable[[Column], Column], then: Callable[[Column], Column], otherwise: Callable[[Column], Column]) -> Builder:
    return lambda c: F.when(F.coalesce(test(c[source]), F.lit(False)), then(c[source])).otherwise(otherwise(c[source]))


def threshold(source: str, bound: float, above: Any, below: Any, is_float: bool = True) -> Builder:
    """``above`` from the bound on, else ``below``; null and NaN are below."""
    return lambda c: F.when(at_least(c[source], bound, is_float), F.lit(above)).otherwise(F.lit(below))


def _cases(pairs: list[tuple[Column, Column]], default: Column | None) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    if out is None:
        return F.lit(None) if default is None else default
    return out if default is None else out.otherwise(default)


def switch(selector: str, cases: Mapping[Any, str], default: str | None = None) -> Builder:
    """The node that the selector's value names; else the default node, or null."""
    return lambda c: _cases([(c[selector] == F.lit(k), c[s]) for k, s in cases.items()], None if default is None else c[default])


def switch_computed(selector: str, cases: Mapping[Any, Callable[[Columns], Column]], default: Callable[[Columns], Column] | None = None) -> Builder:
    """The expression that the selector's value names, over all parents."""
    return lambda c: _cases([(c[selector] == F.lit(k), fn(c)) for k, fn in cases.items()], None if default is None else default(c))
