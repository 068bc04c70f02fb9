import random

from pyspark.sql import functions as F

from millrace.graph import Blueprint
from millrace.plans import batches
from millrace.plans.history import diff, diff_kinds, replay
from millrace.sources.stores import ChangeLog, SnapshotStore

LOG = "key string, seq long, input string, value long"


def graph():
    g = Blueprint()
    for s in ("x", "y"):
        g.source(s)
    g.derive("const", lambda c: F.when(c["x"].isNotNull(), 42), ["x"])
    g.derive("after", lambda c: c["const"] + 1, ["const"])
    g.derive("total", lambda c: c["x"] + c["y"], ["x", "y"])
    g.derive("coarse", lambda c: F.floor(c["total"] / 10), ["total"])
    g.derive("both", lambda c: c["coarse"] + c["const"], ["coarse", "const"])
    return g


PY = {
    "const": lambda v: 42 if v["x"] is not None else None,
    "after": lambda v: None if v["const"] is None else v["const"] + 1,
    "total": lambda v: None if v["x"] is None or v["y"] is None else v["x"] + v["y"],
    "coarse": lambda v: None if v["total"] is None else v["total"] // 10,
    "both": lambda v: None if v["coarse"] is None or v["const"] is None else v["coarse"] + v["const"],
}


def naive(rows, g):
    """Event by event, as the incremental engine would."""
    out, state = [], {}
    for key, seq, name, value in sorted(rows, key=lambda r: (r[0], r[1])):
        v, gen = state.setdefault(key, ({n: None for n in g.names}, {n: 0 for n in g.names}))
        moved = set()
        if v[name] != value:
            v[name], gen[name] = value, gen[name] + 1
            moved.add(name)
        for n in g.schedule():
            if any(p in moved for p in g.parents(n)):
                new = PY[n](v)
                changed = new != v[n]
                if changed:
                    v[n], gen[n] = new, gen[n] + 1
                    moved.add(n)
                out.append((key, seq, n, changed, new, gen[n]))
    return sorted(out, key=str)


def test_cutoff(spark):
    log = spark.createDataFrame([("k", 1, "x", 5), ("k", 2, "x", 999), ("k", 3, "x", 999)], LOG)
    h = replay(log, graph(), ["key"], ["seq"])
    assert [(r.seq, r.node_id) for r in h.cut_off(["const", "after"]).collect()] == [(2, "const")]
    assert [(r.seq, r.generation) for r in h.recomputed(["const"]).collect()] == [(1, 1)]
    events = [(r.event, r.node_id) for r in h.trace().where("seq = 2").orderBy("position", F.desc("event")).collect()]
    assert ("SOURCE_CHANGED", "x") in events and ("CUT_OFF", "const") in events and ("INVALIDATED", "after") in events and ("COMPUTED", "after") not in events
    assert h.trace().where("seq = 3").count() == 0


def test_replay_equals_event_by_event(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(3)}", i, rng.choice("xy"), rng.choice([None, 1, 2, 15, 15, 30])) for i in range(120)]
    h = replay(spark.createDataFrame(rows, LOG), graph(), ["key"], ["seq"])
    got = []
    for r in h.frame.collect():
        got += [(r.key, r.seq, n, r[f"{n}__changed"], r[n], r[f"{n}__generation"]) for n in h.graph.derived if r[f"{n}__evaluated"]]
    assert sorted(got, key=str) == naive(rows, graph())


def test_one_exchange(spark):
    log = spark.createDataFrame([("k", 1, "x", 5)], LOG)
    plan = replay(log, graph(), ["key"], ["seq"]).frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_snapshots(spark, tmp_path):
    log = spark.createDataFrame([("k", 1, "x", 10), ("k", 2, "y", 5), ("k", 3, "x", 150), ("j", 3, "x", 1)], LOG)
    h = replay(log, graph(), ["key"], ["seq"])
    a, b = h.snapshot(F.col("seq") <= 2), h.snapshot()
    changed = {(r.key, r.node_id): (r.before, r.after) for r in diff(a, b, ["key"]).collect()}
    assert changed["k", "total"] == (15.0, 155.0) and ("k", "const") not in changed and changed["j", "x"] == (None, 1.0)
    kinds = {(r.key, r.node_id, r.change) for r in diff_kinds(a, b, ["key"]).collect()}
    assert ("j", "x", "NODE_ADDED") in kinds and ("k", "x", "GENERATION_ADVANCED") in kinds and ("k", "x", "VALUE_CHANGED") in kinds
    store = SnapshotStore(spark, str(tmp_path / "snaps"))
    assert len(store) == 0
    store.save("one", a)
    store.save("two", b)
    assert store.names() == ["one", "two"] and store.get("two").count() == b.count()
    for bad in (lambda: store.save("one", a), lambda: store.get("three")):
        try:
            bad()
        except (ValueError, KeyError):
            continue
        raise AssertionError
    assert store.delete("one") and not store.delete("one") and len(store) == 1


def test_change_log(spark):
    log = ChangeLog(graph())
    try:
        log.record("x", 1)
        raise AssertionError
    except RuntimeError:
        log.start()
    for v in (1, 2, 3):
        log.record("x", v, "k")
    back = ChangeLog.from_list(log.to_list(), graph())
    back.start()
    assert back.record("y", 4, "k") == 4 and len(back.of("x")) == 3
    h = replay(back.table(spark, until=3), graph(), ["key"], ["seq"])
    assert h.as_of().first().x == 3.0
    try:
        back.record("total", 1)
        raise AssertionError
    except ValueError:
        back.clear()
    assert back.to_list() == []


def test_transactions(spark):
    log = spark.createDataFrame(
        [(1, 1, "x", 10, False), (2, 1, "x", 11, False), (3, 2, "x", 99, True), (4, 3, "x", 20, False), (5, None, "x", 21, False), (6, None, "x", 98, True)],
        "seq long, txn long, input string, value long, bad boolean",
    )
    kept = batches.without_failed(log, "txn", "bad")
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 4, 5]
    last = {r.txn: r.value for r in batches.collapse(kept.where("txn is not null"), "txn", "input", "value", "seq").collect()}
    assert last == {1: 11, 3: 20}
    runs = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("k", 3, False)], "key string, n long, failed boolean")
    assert [r.n for r in batches.until_failure(runs, ["key"], "n", "failed").orderBy("n").collect()] == [1, 2]
    gate = batches.validated(spark.createDataFrame([(1, 5), (1, None), (2, 7)], "b long, v long"), "b", F.col("v") > 0)
    assert {(r.b, r.accepted) for r in gate.collect()} == {(1, False), (2, True)}
    state = replay(spark.createDataFrame([("k", 1, "x", 10), ("k", 2, "y", 5)], LOG), graph(), ["key"], ["seq"]).as_of()
    assert batches.dry_run(state, graph(), {"x": F.lit(100)}, ["total"], ["key"]).first().total == 105
