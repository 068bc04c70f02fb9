"""Keeping blueprints, snapshots and change logs."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.graph.blueprint import Blueprint, Builder


class StorageError(ValueError):
    """Something cannot be stored or read back."""


class Builders:
    """Builders by name: a stored blueprint refers to them."""

    def __init__(self) -> None:
        self._by_name: dict[str, Builder] = {}

    def register(self, name: str, build: Builder) -> Builder:
        self._by_name[name] = build
        return build

    def __getitem__(self, name: str) -> Builder:
        try:
            return self._by_name[name]
        except KeyError:
            raise StorageError(f"no builder is called {name}") from None

    def name_of(self, build: Builder) -> str | None:
        return next((k for k, v in self._by_name.items() if v is build), None)


def to_json(graph: Blueprint, builders: Builders, generations: dict[str, int] | None = None) -> str:
    """The blueprint as JSON; each builder must be registered, or its node labelled with a registered name."""
    nodes = []
    for n in map(graph.node, graph.names):
        label = None if n.is_source else n.label or builders.name_of(n.build)
        if not n.is_source and label is None:
            raise StorageError(f"{n.name}: its builder is not registered")
        nodes.append({"name": n.name, "parents": list(n.parents), "priority": n.priority, "stateful": n.stateful, "builder": label})
    return json.dumps({"version": 1, "nodes": nodes, "generations": generations or {}}, indent=2)


def from_json(text: str, builders: Builders) -> tuple[Blueprint, dict[str, int]]:
    """The blueprint and the generations stored with it."""
    data = json.loads(text)
    if data.get("version") != 1:
        raise StorageError(f"unknown version {data.get('version')}")
    graph, left = Blueprint(), {n["name"]: n for n in data["nodes"]}
    while left:
        ready = [n for n in left.values() if all(p in graph for p in n["parents"])]
        if not ready:
            raise StorageError(f"parents are missing for {sorted(left)}")
        for n in ready:
            del left[n["name"]]
            if n["builder"] is None:
                graph.source(n["name"])
            else:
                graph.derive(n["name"], builders[n["builder"]], n["parents"], priority=n["priority"], stateful=n["stateful"], label=n["builder"])
    return graph, dict(data["generations"])


class SnapshotStore:
    """Named snapshots (``History.snapshot``) in one folder, partitioned by name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def save(self, name: str, snapshot: DataFrame) -> None:
        if name in self.names():
            raise ValueError(f"snapshot {name} exists already")
        snapshot.write.parquet(f"{self.path}/name={name}")

    def get(self, name: str) -> DataFrame:
        if name not in self.names():
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/name={name}")

    def names(self) -> list[str]:
        """In the order of saving."""
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().startswith("name=")]
        return [n.removeprefix("name=") for _, n in sorted(found)]

    def delete(self, name: str) -> bool:
        if name not in self.names():
            return False
        fs, at = self._fs(f"{self.path}/name={name}")
        return fs.delete(at, True)

    def __len__(self) -> int:
        return len(self.names())


class ChangeLog:
    """Recorded changes of sources, to be replayed by ``history.replay``."""

    SCHEMA = "key string, seq long, input string, value double"

    def __init__(self, graph: Blueprint) -> None:
        self.graph, self.entries = graph, []
        self.recording = False

    def start(self) -> None:
        self.recording = True

    def stop(self) -> None:
        self.recording = False

    def record(self, source: str, value: float | None, key: str = "") -> int:
        """Append a change; sequence numbers go on from the greatest so far."""
        if not self.recording:
            raise RuntimeError("the log is not recording")
        if source not in self.graph.sources:
            raise ValueError(f"{source} is not a source")
        seq = max((e["seq"] for e in self.entries), default=0) + 1
        self.entries.append({"key": key, "seq": seq, "input": source, "value": value})
        return seq

    def of(self, source: str) -> list[dict[str, Any]]:
        return [e for e in self.entries if e["input"] == source]

    def clear(self) -> None:
        self.entries.clear()

    def to_list(self) -> list[dict[str, Any]]:
        return [dict(e) for e in self.entries]

    @classmethod
    def from_list(cls, entries: list[dict[str, Any]], graph: Blueprint) -> ChangeLog:
        log = cls(graph)
        log.entries = [dict(e) for e in entries]
        return log

    def table(self, spark: SparkSession, until: int | None = None) -> DataFrame:
        rows = [(e["key"], e["seq"], e["input"], None if e["value"] is None else float(e["value"])) for e in self.entries]
        df = spark.createDataFrame(rows, self.SCHEMA)
        return df if until is None else df.where(F.col("seq") <= until)
