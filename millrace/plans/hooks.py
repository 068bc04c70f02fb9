"""Callbacks around the evaluation of nodes, plugins that bring them, and a log of what happened."""

from __future__ import annotations

import itertools
import time
from collections import deque
from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

PHASES = ("before_propagate", "after_propagate", "before_evaluate", "after_evaluate", "cut_off", "error")


@dataclass
class Moment:
    """What a hook is told. A hook may cancel the evaluation it is told of."""

    phase: str
    node: str | None
    details: dict[str, Any] = field(default_factory=dict)
    cancelled: bool = False


@dataclass
class _Hook:
    id: str
    phase: str
    call: Callable[[Moment], None]
    priority: int
    nodes: frozenset[str] | None
    enabled: bool = True
    fired: int = 0


class HookBoard:
    def __init__(self) -> None:
        self._hooks: dict[str, _Hook] = {}
        self._numbers = itertools.count(1)
        self.suppressed = False

    def on(self, phase: str, call: Callable[[Moment], None], priority: int = 10, nodes: Collection[str] | None = None) -> str:
        """Register; lower priorities come first. ``nodes`` restricts the hook to moments of those nodes."""
        if phase not in PHASES:
            raise ValueError(f"unknown phase {phase}")
        name = f"hook_{next(self._numbers)}"
        self._hooks[name] = _Hook(name, phase, call, priority, None if nodes is None else frozenset(nodes))
        return name

    def off(self, name: str) -> bool:
        return self._hooks.pop(name, None) is not None

    def enable(self, name: str, enabled: bool = True) -> None:
        self._hooks[name].enabled = enabled

    def clear(self, phase: str | None = None) -> int:
        gone = [h.id for h in self._hooks.values() if phase in (None, h.phase)]
        for name in gone:
            del self._hooks[name]
        return len(gone)

    def of(self, phase: str) -> list[str]:
        return [h.id for h in self._ordered(phase)]

    def _ordered(self, phase: str) -> list[_Hook]:
        return sorted((h for h in self._hooks.values() if h.phase == phase), key=lambda h: (h.priority, int(h.id.split("_")[1])))

    def fire(self, moment: Moment) -> Moment:
        """Call all enabled hooks of the phase in order, up to one that cancels."""
        if self.suppressed:
            return moment
        for h in self._ordered(moment.phase):
            if h.enabled and (h.nodes is None or moment.node in h.nodes):
                h.fired += 1
                h.call(moment)
                if moment.cancelled:
                    break
        return moment

    def stats(self) -> dict[str, Any]:
        by: dict[str, int] = {}
        for h in self._hooks.values():
            by[h.phase] = by.get(h.phase, 0) + 1
        return {"hooks": len(self._hooks), "by_phase": by, "fired": {h.id: h.fired for h in self._hooks.values()}}


class Plugin:
    """Override what is needed. ``needs`` names plugins that must be active first."""

    name = "plugin"
    version = "1"
    tags: frozenset[str] = frozenset()
    needs: tuple[str, ...] = ()

    def load(self) -> None:
        """Called once before the first activation."""

    def activate(self, hooks: HookBoard) -> list[str]:
        """Register hooks; their ids are taken off on deactivation."""
        return []

    def deactivate(self) -> None:
        """Called before the hooks go."""


class PluginBoard:
    """Plugins and their states: registered, loaded, active, error."""

    def __init__(self, hooks: HookBoard) -> None:
        self.hooks = hooks
        self._plugins: dict[str, Plugin] = {}
        self.state: dict[str, str] = {}
        self._ids: dict[str, list[str]] = {}
        self.errors: dict[str, Exception] = {}

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self._plugins:
            raise ValueError(f"{plugin.name} exists already")
        self._plugins[plugin.name], self.state[plugin.name] = plugin, "registered"

    def _run(self, name: str, step: Callable[[], Any], state: str) -> bool:
        try:
            got = step()
        except Exception as e:
            self.state[name], self.errors[name] = "error", e
            return False
        if isinstance(got, list):
            self._ids[name] = got
        self.state[name] = state
        return True

    def load(self, name: str, _chain: tuple[str, ...] = ()) -> bool:
        if name in _chain:
            raise RuntimeError(f"plugins need one another: {' -> '.join((*_chain, name))}")
        plugin = self._plugins[name]
        for need in plugin.needs:
            if need not in self._plugins:
                raise RuntimeError(f"{name} needs {need}, which is not registered")
            if self.state[need] in ("registered", "error") and not self.load(need, (*_chain, name)):
                return False
        return self.state[name] in ("loaded", "active") or self._run(name, plugin.load, "loaded")

    def activate(self, name: str) -> bool:
        if self.state[name] == "active":
            return True
        if not self.load(name):
            return False
        if not all(self.activate(n) for n in self._plugins[name].needs):
            return False
        return self._run(name, lambda: list(self._plugins[name].activate(self.hooks)), "active")

    def deactivate(self, name: str) -> bool:
        if self.state.get(name) != "active":
            return False
        done = self._run(name, self._plugins[name].deactivate, "loaded")
        for h in self._ids.pop(name, []):
            self.hooks.off(h)
        return done

    def unload(self, name: str) -> bool:
        self.deactivate(name)
        if self.state.get(name) != "loaded":
            return False
        self.state[name] = "registered"
        return True

    def unregister(self, name: str) -> bool:
        self.deactivate(name)
        self.state.pop(name, None)
        return self._plugins.pop(name, None) is not None

    def get(self, name: str) -> Plugin | None:
        return self._plugins.get(name)

    def names(self, state: str | None = None) -> list[str]:
        return sorted(n for n, s in self.state.items() if state in (None, s))

    def tagged(self, tag: str) -> list[str]:
        return sorted(n for n, p in self._plugins.items() if tag in p.tags)


class EventLog(Plugin):
    """Keeps the last entries of what hooks are told, and sums up times by node."""

    name = "event_log"
    LEVELS = {"debug": 0, "info": 1, "warning": 2, "error": 3}
    _LEVEL_OF = {"before_evaluate": "debug", "error": "error"}

    def __init__(self, level: str = "info", most: int = 1000, nodes: Collection[str] | None = None, out: Callable[[dict], None] | None = None) -> None:
        self.level, self.nodes, self.out = level, nodes, out
        self.entries: deque[dict] = deque(maxlen=most)

    def activate(self, hooks: HookBoard) -> list[str]:
        return [hooks.on(p, self._note, 100, self.nodes) for p in PHASES]

    def _note(self, m: Moment) -> None:
        level = self._LEVEL_OF.get(m.phase, "info")
        if self.LEVELS[level] < self.LEVELS[self.level]:
            return
        entry = {"at": time.time(), "level": level, "phase": m.phase, "node": m.node, "seconds": m.details.get("seconds")}
        self.entries.append(entry)
        if self.out:
            self.out(entry)

    def slow(self, seconds: float) -> list[dict]:
        return [e for e in self.entries if (e["seconds"] or 0.0) >= seconds]

    def timing(self) -> dict[str, dict[str, float]]:
        by: dict[str, list[float]] = {}
        for e in self.entries:
            if e["seconds"] is not None:
                by.setdefault(e["node"], []).append(e["seconds"])
        return {n: {"count": len(v), "total": sum(v), "mean": sum(v) / len(v), "max": max(v)} for n, v in by.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(e["at"], e["level"], e["phase"], e["node"], e["seconds"]) for e in self.entries]
        return spark.createDataFrame(rows, "at double, level string, phase string, node string, seconds double")
