"""``python -m millrace.cli COMMAND module:function ...``; the function returns a Blueprint."""

from __future__ import annotations

import argparse
import importlib
import sys
from typing import Any

from millrace import __version__
from millrace.graph import render
from millrace.graph.blueprint import Blueprint


def load(where: str) -> Blueprint:
    module, _, name = where.partition(":")
    got = getattr(importlib.import_module(module), name or "graph")
    return got() if callable(got) else got


def parse_values(given: list[str]) -> dict[str, Any]:
    """``name=value`` pairs; values are integers, floats or else texts. The first = splits."""
    out: dict[str, Any] = {}
    for item in given:
        name, sep, value = item.partition("=")
        if not sep or not name:
            raise ValueError(f"not of the form name=value: {item}")
        for kind in (int, float, str):
            try:
                out[name] = kind(value)
                break
            except ValueError:
                continue
    return out


def values_of(graph: Blueprint, given: dict[str, Any], wanted: list[str] | None = None) -> dict[str, Any]:
    """The values of the nodes that follow from the given ones."""
    from pyspark.sql import SparkSession

    from millrace.plans.evaluate import evaluate

    wanted = [n for n in wanted or graph.names if all(s in given for s in graph.restricted([n]).sources)]
    if not wanted:
        return {}
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    return evaluate(spark.createDataFrame([given]), graph, wanted).first().asDict()


def inspect(graph: Blueprint, target: str | None, depth: int, given: dict[str, Any] | None = None) -> int:
    values = values_of(graph, given) if given else {}
    shown = lambda n: {"value": values[n]} if n in values else {"value": ""} if values else {}
    if target is None:
        levels = graph.levels()
        print(f"{len(graph)} nodes, {len(graph.sources)} sources, depth {max(levels.values(), default=0)}")
        print(render.as_table([{"node": n, "kind": "source" if graph.node(n).is_source else "derived", "level": levels[n], "parents": ", ".join(graph.parents(n)), **shown(n)} for n in graph.names]))
        return 0
    if target not in graph:
        print(f"unknown node {target}", file=sys.stderr)
        return 1
    print(f"{target}: parents {', '.join(graph.parents(target)) or '-'}; children {', '.join(graph.children(target)) or '-'}")
    if target in values:
        print(f"value {values[target]}")
    if depth > 1:
        print(f"upstream {', '.join(sorted(graph.upstream(target))) or '-'}; downstream {', '.join(sorted(graph.downstream(target))) or '-'}")
    return 0


def validate(graph: Blueprint, strict: bool, cycles: bool = True, orphans: bool = True) -> int:
    """Errors always fail, warnings only if strict. Blueprints refuse cycles as they are built; one made otherwise is found here."""
    errors = [f"{n}: unknown parent {p}" for n in graph.derived for p in graph.parents(n) if p not in graph]
    if cycles and not errors:
        errors += [f"{n}: on a cycle" for n in graph.derived if graph.reaches(n, n)]
    warnings = []
    if orphans:
        warnings += [f"{n}: source without children" for n in graph.sources if not graph.children(n)]
        warnings += [f"{n}: depends on no source" for n in graph.derived if not errors and not any(graph.node(u).is_source for u in graph.upstream(n))]
    print("\n".join(errors + warnings) or "no issues")
    return int(bool(errors) or bool(warnings) and strict)


def run(graph: Blueprint, given: dict[str, Any], outputs: list[str], dry: bool) -> int:
    unknown = [n for n in (*given, *outputs) if n not in graph]
    if unknown:
        print(f"unknown nodes: {', '.join(unknown)}", file=sys.stderr)
        return 1
    if dry:
        print("would be evaluated: " + (", ".join(sorted(graph.downstream(*given))) if given else "-"))
        return 0
    wanted = outputs or graph.derived
    missing = [s for s in graph.restricted(wanted).sources if s not in given]
    if missing:
        print(f"values are missing for: {', '.join(missing)}", file=sys.stderr)
        return 1
    row = values_of(graph, given, wanted)
    print(render.as_table([{"node": n, "value": row[n]} for n in wanted]))
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("--version", action="version", version=f"millrace {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "validate", "export", "run"):
        c = sub.add_parser(name)
        c.add_argument("graph", help="module:function")
        if name == "inspect":
            c.add_argument("node", nargs="?")
            c.add_argument("--depth", type=int, default=1)
            c.add_argument("--values", action="append", default=[], metavar="NAME=VALUE", help="show what follows from these")
        elif name == "validate":
            c.add_argument("--strict", action="store_true")
            c.add_argument("--cycles", action=argparse.BooleanOptionalAction, default=True)
            c.add_argument("--orphans", action=argparse.BooleanOptionalAction, default=True)
        elif name == "export":
            c.add_argument("--format", choices=["json", "dot", "mermaid"], default="json")
            c.add_argument("--output", required=True)
            c.add_argument("--values", action="append", default=[], metavar="NAME=VALUE")
        else:
            c.add_argument("--input", action="append", default=[], metavar="NAME=VALUE")
            c.add_argument("--output", action="append", default=[])
            c.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    graph = load(a.graph)
    if a.command == "inspect":
        return inspect(graph, a.node, a.depth, parse_values(a.values))
    if a.command == "validate":
        return validate(graph, a.strict, a.cycles, a.orphans)
    if a.command == "export":
        values = values_of(graph, parse_values(a.values)) if a.values else None
        text = {"json": lambda: render.as_json(graph, values), "dot": lambda: render.dot(graph, values), "mermaid": lambda: render.mermaid(graph)}[a.format]()
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
        return 0
    return run(graph, parse_values(a.input), a.output, a.dry_run)


if __name__ == "__main__":
    sys.exit(main())
