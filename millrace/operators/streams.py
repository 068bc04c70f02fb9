"""Stream operators over event tables: what a live stream would let through, row by row.

All take events with keys (a stream each), an order and, where time counts, a timestamp column.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def observe(events: DataFrame, node: str, observed: Sequence[str]) -> DataFrame:
    """Only events of the observed nodes."""
    return events.where(F.col(node).isin(list(observed)))


def overflow(events: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, drop: str = "oldest") -> DataFrame:
    """What is left in a paused stream's buffer of ``size`` after all events arrived.

    ``drop``: "oldest" evicts the head for each arrival, "newest" refuses arrivals once full, and "error"
    raises when the query runs.
    """
    size = max(1, size)
    up = _by(keys, order)
    if drop == "newest":
        return events.withColumn("__n", F.row_number().over(up)).where(F.col("__n") <= size).drop("__n")
    if drop == "error":
        n = F.row_number().over(up)
        return events.withColumn("__n", F.when(n > size, F.raise_error(F.lit("the buffer is full")).cast("int")).otherwise(n)).where(F.col("__n") > 0).drop("__n")
    if drop != "oldest":
        raise ValueError(f"unknown overflow strategy {drop}")
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("__n", F.row_number().over(down)).where(F.col("__n") <= size).drop("__n")


def dropped_count(events: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    return events.groupBy(*keys).agg(F.greatest(F.count("*") - max(1, size), F.lit(0)).alias("dropped"))


def debounce(events: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, quiet_seconds: float, flush_last: bool = False) -> DataFrame:
    """An event passes when the next one comes at least the quiet period later. The last waits for ever unless flushed."""
    w = _by(keys, order)
    gap = F.lead(_micros(F.col(ts))).over(w) - _micros(F.col(ts))
    test = gap >= int(quiet_seconds * 1_000_000)
    return events.withColumn("__out", F.coalesce(test, F.lit(flush_last))).where("__out").drop("__out")


def _segments(batch, keys: Sequence[str], last: tuple | None):
    """Where keys change in an Arrow batch sorted by them: bounds, the keys there, and whether the first goes on from ``last``."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    new[0] = True
    start = np.flatnonzero(new)
    names = [tuple(batch.column(k)[int(i)].as_py() for k in keys) for i in start]
    return start.tolist(), [*start.tolist()[1:], n], names, last is not None and names[0] == last


def _walk_throttle(keys: Sequence[str], interval: int, out: Sequence[str]):
    """Rows sorted by key and order stream past; all that is kept is the time of the present key's last emission."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, keep = batch.column("__t").to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
            start, stop, names, same = _segments(batch, keys, key)
            for k, (a, b) in enumerate(zip(start, stop, strict=True)):
                if k or not same:
                    last = None
                part = t[a:b]
                if (part[1:] >= part[:-1]).all():  # in the order of time: leap from emission to emission
                    i = 0 if last is None else int(np.searchsorted(part, last + interval))
                    while i < len(part):
                        keep[a + i], last = True, int(part[i])
                        i = max(i + 1, int(np.searchsorted(part, last + interval)))
                else:
                    for i, x in enumerate(part.tolist(), a):
                        if last is None or x - last >= interval:
                            keep[i], last = True, x
            key = names[-1]
            yield batch.select(list(out)).filter(pa.array(keep))

    return run


def _walk_buffers(keys: Sequence[str], limit: int, size: int, out: Sequence[str]):
    """Rows stream past; those of the present key's open buffer, fewer than ``size``, are held back until it is flushed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, held, number = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            start, stop, names, same = _segments(batch, keys, key)
            rows, marks = [], []
            for k, (a, b) in enumerate(zip(start, stop, strict=True)):
                part = batch.slice(a, b - a)
                if k or not same:
                    number = 0
                elif held:
                    part = pa.concat_batches([*held, part])
                held = []
                t = part.column("__t").to_numpy(zero_copy_only=False)
                ordered, at = bool((t[1:] >= t[:-1]).all()), 0
                while at < len(t):
                    late = int(np.searchsorted(t, t[at] + limit)) if ordered else at + int(np.argmax(np.append(t[at:] - t[at] >= limit, True)))
                    end = min(at + size - 1, max(late, at))
                    if end >= len(t):
                        break
                    rows.append(part.slice(at, end + 1 - at))
                    marks.append((number, end + 1 - at))
                    number, at = number + 1, end + 1
                if at < len(t):
                    held = [part.slice(at)]
            key = names[-1]
            if rows:
                done = pa.concat_batches([r.select(list(out)) for r in rows])
                mark = pa.array(np.repeat([m for m, _ in marks], [n for _, n in marks]).astype(np.int64))
                yield pa.record_batch([*done.columns, mark], names=[*out, "batch"])

    return run


def _in_order(events: DataFrame, by: Sequence[str], order: Sequence[str], ts: str) -> DataFrame:
    """Events with a time, in partitions by key, sorted: one exchange and one sort that spills, no list of a key's events."""
    slim = events.select(*by, *order, _micros(F.col(ts)).alias("__t")).where("__t is not null")
    return (slim.repartition(*[F.col(c) for c in by]) if by else slim.coalesce(1)).sortWithinPartitions(*by, *order)


def throttle(events: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, interval_seconds: float, bucket: str | None = None) -> DataFrame:
    """Greedy rate limit: an event passes if the interval has gone by since the last that passed. Events without a time do not.

    Each emission depends on the one before, so a key's events are walked in order, in one task; a worker holds a
    batch of them, however many there are. ``bucket``, a column that restarts the limit, splits hot keys.
    """
    by = [*keys, *([bucket] if bucket else [])]
    rows = _in_order(events, by, order, ts)
    out = list(dict.fromkeys([*by, *order]))
    return rows.mapInArrow(_walk_throttle(by, int(interval_seconds * 1_000_000), out), T.StructType([rows.schema[c] for c in out]))


def buffer_batches(events: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, keep_tail: bool = False) -> DataFrame:
    """``batch``: the number of the full buffer that an event left with; the unfilled rest is not flushed unless asked."""
    w = _by(keys, order)
    out = events.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    if keep_tail:
        return out
    whole = Window.partitionBy(*keys, "batch")
    return out.withColumn("__n", F.count("*").over(whole)).where(F.col("__n") == size).drop("__n")


def buffer_time(events: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, seconds: float, size: int) -> DataFrame:
    """Like ``buffer_batches``, but an arrival also flushes once ``seconds`` have passed since the buffer's first event.

    Walked like ``throttle``; a worker holds a batch of rows and one open buffer.
    """
    rows = _in_order(events, keys, order, ts)
    out = list(dict.fromkeys([*keys, *order]))
    schema = T.StructType([*(rows.schema[c] for c in out), T.StructField("batch", T.LongType())])
    return rows.mapInArrow(_walk_buffers(list(keys), int(seconds * 1_000_000), size, out), schema)


def last_per_node(batches: DataFrame, keys: Sequence[str], node: str, value: str, order: Sequence[str]) -> DataFrame:
    """What a flushed buffer passes on: the last value of each node in it."""
    last = F.max_by(F.struct(F.col(value)), F.struct(*order))[value]
    return batches.groupBy(*keys, "batch", node).agg(last.alias(value))


def merge(*streams: DataFrame) -> DataFrame:
    """All events of two or more streams; order them by their time where order counts."""
    if len(streams) < 2:
        raise ValueError("two streams are needed at least")
    return functools.reduce(lambda a, b: a.unionByName(b), streams)


def combine_latest(events: DataFrame, keys: Sequence[str], order: Sequence[str], source: str, value: str, sources: Sequence[str]) -> DataFrame:
    """After every source has had an event: for each event the latest value of all sources."""
    w = _by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    mine = events.where(F.col(source).isin(list(sources)))
    latest = {f"latest_{s}": F.last(F.when(F.col(source) == s, F.col(value)), ignorenulls=True).over(w) for s in sources}
    return mine.withColumns(latest).where(functools.reduce(lambda a, b: a & b, [F.col(f"latest_{s}").isNotNull() for s in sources]))


# --- deferred work: a queue as a table -----------------------------------------------------------------------


def coalesce_tasks(requests: DataFrame, node: str, priority: str, order: str, delay: str) -> DataFrame:
    """Pending tasks: a node asked for again is not queued again, but its priority rises; its first delay stays."""
    return requests.groupBy(node).agg(F.min(priority).alias(priority), F.min(order).alias(order), F.min_by(delay, order).alias(delay), F.min_by("trigger_time", order).alias("trigger_time"))


def tick(tasks: DataFrame, now: float, limit: int | None = None, priority: str = "priority", order: str = "seq") -> DataFrame:
    """The ready tasks that a tick takes, by priority and then by order."""
    ready = tasks.where(F.col("trigger_time") + F.col("delay") <= now).orderBy(priority, order)
    return ready if limit is None else ready.limit(limit)


def cancel(tasks: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    return tasks.join(nodes, node, "left_anti")


def group_stats(subscriptions: DataFrame, group: str = "grp", state: str = "state") -> DataFrame:
    """Subscriptions of each group by state."""
    states = ["active", "paused", "disposed"]
    return subscriptions.groupBy(group).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])
