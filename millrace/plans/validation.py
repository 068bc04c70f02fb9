"""Constraints on node values, checked for all rows at once; violations come as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Check = tuple[str, str, Callable[[Column], Column]]


class Checks:
    """A registry of constraints by node. Each gives a message, or null where the value is fine."""

    def __init__(self) -> None:
        self._checks: list[Check] = []

    def add(self, node: str, name: str, message: Callable[[Column], Column]) -> Checks:
        self._checks.append((node, name, message))
        return self

    def remove(self, node: str, name: str) -> bool:
        before = len(self._checks)
        self._checks = [c for c in self._checks if c[:2] != (node, name)]
        return len(self._checks) < before

    def of(self, node: str) -> list[str]:
        return [name for n, name, _ in self._checks if n == node]

    @property
    def nodes(self) -> list[str]:
        return sorted({n for n, _, _ in self._checks})

    def between(self, node: str, low: float | None = None, high: float | None = None, allow_null: bool = True, name: str = "range") -> Checks:
        """Bounds are inclusive; NaN lies outside any bound."""

        def message(c: Column) -> Column:
            out = F.when(c.isNull(), F.lit(None if allow_null else "null is not allowed"))
            value = c.cast("double")
            if low is not None:
                out = out.when((value < low) | F.isnan(value), f"below {low}")
            if high is not None:
                out = out.when((value > high) | F.isnan(value), f"above {high}")
            return out

        return self.add(node, name, message)

    def castable(self, node: str, kind: str, name: str = "type") -> Checks:
        return self.add(node, name, lambda c: F.when(c.isNotNull() & c.cast("string").try_cast(kind).isNull(), f"not a {kind}"))

    def of_type(self, node: str, *kinds: type[T.DataType], name: str = "type") -> Checks:
        """The column's type, known when the query is planned: all rows pass or all fail."""
        return self.add(node, name, lambda c: F.when(c.isNotNull() & ~F.typeof(c).isin([k.typeName() for k in kinds]), F.concat(F.lit("type is "), F.typeof(c))))

    def holds(self, node: str, name: str, test: Callable[[Column], Column], message: str) -> Checks:
        """Null values pass; where the test is not true, the message is given."""
        return self.add(node, name, lambda c: F.when(c.isNotNull() & ~F.coalesce(test(c), F.lit(False)), message))

    def violations(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``keys, node_id, constraint, message`` for every violation; one pass over the rows."""
        if not self._checks:
            return df.select(*keys, *[F.lit("").alias(c) for c in ("node_id", "constraint", "message")]).where(F.lit(False))
        found = F.array(*[F.struct(F.lit(n).alias("node_id"), F.lit(k).alias("constraint"), m(F.col(n)).alias("message")) for n, k, m in self._checks])
        rows = df.select(*keys, F.explode(F.filter(found, lambda v: v["message"].isNotNull())).alias("v"))
        return rows.select(*keys, "v.*")

    def row_is_valid(self) -> Column:
        """Whether a row passes everything: a gate for batches."""
        out = F.lit(True)
        for n, _, m in self._checks:
            out = out & m(F.col(n)).isNull()
        return out
