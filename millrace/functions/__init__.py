"""Scalar building blocks whose meaning SQL does not give directly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(value: Column, kind: T.DataType) -> Column:
    """Whether a value counts as true: non-zero numbers (NaN too), non-empty strings and collections; null never."""
    if isinstance(kind, T.BooleanType):
        test = value
    elif isinstance(kind, T.NumericType):
        test = value != 0
    elif isinstance(kind, T.StringType):
        test = F.length(value) > 0
    elif isinstance(kind, T.ArrayType | T.MapType):
        test = F.size(value) > 0
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def at_least(value: Column, bound: float, is_float: bool = True) -> Column:
    """``value >= bound`` with false for null and NaN."""
    test = value >= F.lit(bound)
    return F.coalesce((~F.isnan(value) & test) if is_float else test, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality, the test that decides whether anything changed."""
    return ~a.eqNullSafe(b)


def cents(amount: Column) -> Column:
    """An amount with two decimals as whole hundredths."""
    return F.round(amount * 100).cast("long")


def same_entries(a: Column, b: Column) -> Column:
    """Whether two maps hold the same entries."""
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def short_checksum(*parts: Column) -> Column:
    """First eight hex digits of the md5 of the parts joined by colons; nulls count as empty."""
    return F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 8)
