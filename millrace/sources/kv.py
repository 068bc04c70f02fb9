"""A key-value store as an append-only table of operations, and a small LRU-like view of it."""

from __future__ import annotations

import abc
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import short_checksum
from millrace.sources.claims import claim, exists

SCHEMA = "seq long, op string, key string, value_json string, generation long, checksum string"


def latest(log: DataFrame, seq: str = "seq", op: str = "op", key: str = "key", value: str = "value") -> DataFrame:
    """The store's content: the last operation of each key after the last ``clear``, deletions left out."""
    cleared = log.where(F.col(op) == "clear").agg(F.coalesce(F.max(seq), F.lit(-(1 << 62))).alias("__cleared"))
    live = log.where(F.col(op) != "clear").join(F.broadcast(cleared)).where(F.col(seq) > F.col("__cleared"))  # one row
    last = live.groupBy(key).agg(F.max_by(F.struct(op, value), seq).alias("s"), F.max(seq).alias(seq))
    return last.where(F.col(f"s.{op}") == "put").select(key, F.col(f"s.{value}").alias(value), seq)


def get_many(content: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """One row for each asked key; missing ones have nulls."""
    return keys.join(content, key, "left")


def lru_resident(accesses: DataFrame, capacity: int, key: str = "key", seq: str = "seq") -> DataFrame:
    """The keys that a cache of that capacity holds after all accesses: those used last."""
    return accesses.groupBy(key).agg(F.max(seq).alias(seq)).orderBy(F.desc(seq)).limit(capacity)


def hit_rate(hits, misses):
    """Share of reads that found their key; 0 without reads."""
    return F.coalesce(F.try_divide(hits.cast("double"), hits + misses), F.lit(0.0))


@dataclass(frozen=True)
class Stats:
    entries: int
    writes: int
    reads: int
    hits: int
    misses: int

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class Store(abc.ABC):
    """What every store can do. A key that is not there reads as None."""

    @abc.abstractmethod
    def get(self, key: str) -> Any: ...

    @abc.abstractmethod
    def put_many(self, entries: Mapping[str, Any], generation: int = 0) -> None: ...

    @abc.abstractmethod
    def delete(self, key: str) -> bool:
        """Whether the key was there."""

    @abc.abstractmethod
    def clear(self) -> int:
        """How many entries went."""

    @abc.abstractmethod
    def keys(self) -> list[str]: ...

    @abc.abstractmethod
    def size(self) -> int: ...

    @abc.abstractmethod
    def stats(self) -> Stats: ...

    def put(self, key: str, value: Any, generation: int = 0) -> None:
        self.put_many({key: value}, generation)

    def get_many(self, keys: Iterable[str]) -> dict[str, Any]:
        return {k: self.get(k) for k in keys}

    def exists(self, key: str) -> bool:
        return key in self.keys()


_ROW = "key string, value_json string, generation long"


class TableStore(Store):
    """A durable store: operations are appended as Parquet, reading takes the latest of each key.

    Values are JSON texts. The folder may be on any file system that Spark reaches. Each write draws a number
    of its own, so writers at the same time do not mix; the rows of a write are one commit.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._reads = self._hits = 0

    def log(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/ops"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/ops")

    def _append(self, ops: DataFrame, few: bool = False) -> None:
        """``ops(place, op, key, value_json, generation)``, place ordering the rows of this write."""
        at = claim(self.spark, self.path) << 32
        rows = ops.select((F.col("place") + at).alias("seq"), "op", "key", "value_json", "generation")
        rows = rows.withColumn("checksum", short_checksum(F.col("seq"), F.col("op"), F.col("key"), F.col("value_json")))
        (rows.coalesce(1) if few else rows).write.mode("append").parquet(f"{self.path}/ops")

    def _append_rows(self, rows: list[tuple]) -> None:
        if rows:
            df = self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place long, op string, {_ROW}")
            self._append(df, few=True)

    def put_many(self, entries: Mapping[str, Any], generation: int = 0) -> None:
        self._append_rows([("put", k, json.dumps(v, default=str, sort_keys=True), generation) for k, v in entries.items()])

    def put_table(self, rows: DataFrame, generation: int = 0) -> None:
        """Put all ``rows(key, value_json)``; of a repeated key the greatest value stays."""
        last = rows.groupBy("key").agg(F.max("value_json").alias("value_json"))
        self._append(last.select(F.lit(0).cast("long").alias("place"), F.lit("put").alias("op"), "key", "value_json", F.lit(generation).cast("long").alias("generation")))

    def delete_table(self, keys: DataFrame) -> None:
        """Delete all ``keys(key)``."""
        none = F.lit(None).cast("string").alias("value_json")
        self._append(keys.select("key").distinct().select(F.lit(0).cast("long").alias("place"), F.lit("delete").alias("op"), "key", none, F.lit(0).cast("long").alias("generation")))

    def delete(self, key: str) -> bool:
        found = self.exists(key)
        self._append_rows([("delete", key, None, 0)])
        return found

    def clear(self) -> int:
        n = self.size()
        self._append_rows([("clear", "", None, 0)])
        return n

    def content(self) -> DataFrame:
        """``key, value_json, generation, seq`` of the live entries."""
        cleared = self.log().where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__cleared"))  # one row
        live = self.log().where("op <> 'clear'").join(F.broadcast(cleared)).where("seq > __cleared")
        last = live.groupBy("key").agg(F.max_by(F.struct("op", "value_json", "generation", "seq"), "seq").alias("s"))
        return last.where("s.op = 'put'").select("key", "s.value_json", "s.generation", "s.seq")

    def get_many(self, keys: Iterable[str]) -> dict[str, Any]:
        keys = list(keys)
        rows = {r["key"]: json.loads(r["value_json"]) for r in self.content().where(F.col("key").isin(keys)).collect()}
        self._reads += len(keys)
        self._hits += len(rows)
        return {k: rows.get(k) for k in keys}

    def get(self, key: str) -> Any:
        return self.get_many([key])[key]

    def exists(self, key: str) -> bool:
        return self.content().where(F.col("key") == key).limit(1).count() > 0

    def keys(self) -> list[str]:
        return [r["key"] for r in self.content().select("key").orderBy("key").toLocalIterator()]

    def size(self) -> int:
        return self.content().count()

    def snapshot(self) -> DataFrame:
        return self.content().select("key", "value_json", "generation")

    def restore(self, snapshot: DataFrame) -> None:
        """Make ``snapshot(key, value_json, generation)`` the content: clearing and putting are one write."""
        clear = self.spark.createDataFrame([(0, "clear", "", None, 0)], f"place long, op string, {_ROW}")
        puts = snapshot.select(F.lit(1).cast("long").alias("place"), F.lit("put").alias("op"), "key", "value_json", "generation")
        self._append(clear.union(puts))

    def vacuum(self, path: str) -> TableStore:
        """A store at ``path`` with the live entries only, generations kept."""
        out = TableStore(self.spark, path)
        out._append(self.content().select(F.lit(0).cast("long").alias("place"), F.lit("put").alias("op"), "key", "value_json", "generation"))
        return out

    def stats(self) -> Stats:
        return Stats(self.size(), self.log().count(), self._reads, self._hits, self._reads - self._hits)


class LruCache(Store):
    """A bounded in-process store for planning objects; the least recently used key goes first."""

    def __init__(self, capacity: int | None = None) -> None:
        if capacity is not None and capacity < 1:
            raise ValueError("a cache holds one entry at least")
        self.capacity, self._items = capacity, {}
        self.evicted = self.hits = self.misses = self.writes = 0

    def get(self, key: str) -> Any:
        if key not in self._items:
            self.misses += 1
            return None
        self.hits += 1
        self._items[key] = value = self._items.pop(key)
        return value

    def peek(self, key: str) -> Any:
        """Without making the key recent."""
        return self._items.get(key)

    def _make_room(self, n: int) -> None:
        while self._items and self.capacity is not None and len(self._items) + n > self.capacity:
            del self._items[next(iter(self._items))]
            self.evicted += 1

    def put_many(self, entries: Mapping[str, Any], generation: int = 0) -> None:
        """Room for all new keys is made first; what still does not fit goes as the entries come in."""
        self._make_room(sum(k not in self._items for k in entries))
        for k, v in entries.items():
            if self._items.pop(k, self) is self:
                self._make_room(1)
            self._items[k] = v
            self.writes += 1

    def delete(self, key: str) -> bool:
        return self._items.pop(key, self) is not self

    def clear(self) -> int:
        n = len(self._items)
        self._items.clear()
        return n

    def __contains__(self, key: object) -> bool:
        return key in self._items

    def __len__(self) -> int:
        return len(self._items)

    def size(self) -> int:
        return len(self)

    def keys(self) -> list[str]:
        """Oldest first."""
        return list(self._items)

    @property
    def oldest_key(self) -> str | None:
        return next(iter(self._items), None)

    @property
    def newest_key(self) -> str | None:
        return next(reversed(self._items), None)

    def snapshot(self) -> dict[str, Any]:
        return dict(self._items)

    def restore(self, snapshot: Mapping[str, Any]) -> None:
        self._items.clear()
        self.put_many(snapshot)

    @property
    def utilization(self) -> float:
        return 0.0 if not self.capacity else len(self._items) / self.capacity

    @property
    def hit_rate(self) -> float:
        return self.stats().hit_rate

    def stats(self) -> Stats:
        return Stats(len(self), self.writes, self.hits + self.misses, self.hits, self.misses)
