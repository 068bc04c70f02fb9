"""All queries of the engine, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of the event log: every node that took a new value, with its generation."""
    return _QUERIES["history_propagate"](spark, sf_dir)


from millrace.plans import q_apps, q_engine, q_federation, q_graphs, q_history, q_live, q_stores, q_streams, q_values  # noqa: E402, F401  (they register their queries)
