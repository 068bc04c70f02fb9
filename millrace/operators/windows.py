"""Count-based trailing windows over the evaluations of a node.

A window's frame is fixed by the partition and order of the log, so nothing has to be restored when a
transaction is rolled back: rows that do not count are simply not in the frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def restarts(df: DataFrame, keys: Sequence[str], order: Sequence[str], cleared: Column, name: str = "__since") -> DataFrame:
    """``df`` with the number of times that a window was cleared before or at each row; as one more key of ``Trailing`` it empties the window."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(cleared, F.lit(False)).cast("long")).over(upto))


class Trailing:
    """The last ``size`` rows of each key in order, the present one included."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], size: int) -> None:
        if size < 1:
            raise ValueError("a window holds one value at least")
        self.size, self.keys, self.order = size, list(keys), list(order)
        self.base: WindowSpec = Window.partitionBy(*keys).orderBy(*order)
        self.frame = self.base.rowsBetween(-(size - 1), 0)

    def total(self, value: Column) -> Column:
        return F.sum(value).over(self.frame)

    def mean(self, value: Column) -> Column:
        """Divides by the values at hand, fewer than ``size`` at the start."""
        return F.avg(value).over(self.frame)

    def values(self, value: Column) -> Column:
        """The window's content, oldest first."""
        return F.collect_list(value).over(self.frame)

    def last_buffer(self, df: DataFrame, value: Column) -> DataFrame:
        """``keys, values``: what each key's window holds after all rows, oldest first. Never more than ``size`` rows of a key are kept."""
        back = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order])
        rows = df.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= self.size)
        held = F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), value.alias("v"))))
        return rows.groupBy(*self.keys).agg(F.transform(held, lambda x: x["v"]).alias("values"))

    def custom(self, value: Column, fn: Callable[[Column], Column]) -> Column:
        return fn(self.values(value))

    def evicted(self, value: Column) -> Column:
        """The value that this row pushes out; null while there is room."""
        return F.lag(value, self.size).over(self.base)

    def filled(self) -> Column:
        return F.least(F.row_number().over(self.base), F.lit(self.size))

    def is_full(self) -> Column:
        return F.row_number().over(self.base) >= self.size

    def oldest(self, value: Column) -> Column:
        return F.first(value).over(self.frame)

    def newest(self, value: Column) -> Column:
        return F.last(value).over(self.frame)
