import pytest
from pyspark.sql import functions as F

from millrace.graph import Blueprint
from millrace.plans.engine import TransactionError, Workbench, fingerprint
from millrace.plans.hooks import EventLog, HookBoard, Moment, Plugin, PluginBoard


def bench(hooks=None):
    g = Blueprint()
    g.source("sales")
    g.source("costs")
    g.derive("positive", lambda t: t["sales"].where("v > 0"), ["sales"])
    g.derive("revenue", lambda t: t["positive"].agg(F.sum("v").alias("v")), ["positive"])
    g.derive("spent", lambda t: t["costs"].agg(F.sum("v").alias("v")), ["costs"])
    g.derive("profit", lambda t: t["revenue"].union(t["spent"].select(-F.col("v"))).agg(F.sum("v").alias("v")), ["revenue", "spent"])
    return Workbench(g, hooks)


def rows(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v long")


def test_demand_and_cutoff(spark):
    w = bench()
    assert w.set("sales", rows(spark, 100, 200, -50, 300, 150)) == 1
    w.set("costs", rows(spark, 80, 120, 60, 180, 90))
    assert w.demand("profit")["profit"].first().v == 220
    assert w.report.evaluated == ["positive", "revenue", "spent", "profit"]
    w.demand("profit")
    assert w.report.evaluated == []
    # the same rows in another order change nothing
    assert w.set("sales", rows(spark, 150, 300, -50, 200, 100)) == 1
    # a source that changes without a visible effect is cut off at once
    assert w.set("sales", rows(spark, 100, 200, -77, 300, 150)) == 2
    w.propagate("sales")
    assert w.report.cut_off == ["positive"] and w.report.changed == []
    w.set("sales", rows(spark, 1000))
    assert w.propagate("sales").changed == ["positive", "revenue", "profit"] and w.generation("profit") == 2
    assert w.hotspots(1) and w.is_valid("profit")


def test_eviction_keeps_generations(spark):
    w = bench()
    w.set("sales", rows(spark, 1))
    w.set("costs", rows(spark, 1))
    w.demand("profit")
    assert w.evict("revenue") and not w.is_valid("revenue")
    w.demand("profit")
    assert w.report.evaluated == ["revenue"] and w.generation("revenue") == 2
    w.clear()
    assert len(w) == 2
    with pytest.raises(LookupError):
        bench().demand("profit")
    with pytest.raises(ValueError):
        w.set("profit", rows(spark, 1))


def test_transactions(spark):
    w = bench()
    w.set("sales", rows(spark, 10))
    w.set("costs", rows(spark, 1))
    w.demand("profit")
    with pytest.raises(RuntimeError, match="stop"), w.transaction("profit"):
        w.set("sales", rows(spark, 99))
        raise RuntimeError("stop")
    assert w.demand("profit")["profit"].first().v == 9 and w.generation("sales") == 1
    with w.transaction("profit"):
        w.set("sales", rows(spark, 20))
        w.set("costs", rows(spark, 2))
        with pytest.raises(TransactionError), w.transaction():
            pass
    assert w.demand("profit")["profit"].first().v == 18


def test_fingerprint_sees_pairs(spark):
    assert fingerprint(rows(spark, 1, 1)) != fingerprint(rows(spark, 2, 2)) != fingerprint(rows(spark))
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    assert fingerprint(m) == fingerprint(m)


def test_hooks(spark):
    board = HookBoard()
    seen = []
    late = board.on("before_evaluate", lambda m: seen.append(("late", m.node)), priority=20)
    board.on("before_evaluate", lambda m: seen.append(("soon", m.node)), priority=1, nodes=["spent"])
    w = bench(board)
    w.set("sales", rows(spark, 1))
    w.set("costs", rows(spark, 1))
    w.demand("spent")
    assert seen == [("soon", "spent"), ("late", "spent")]
    board.enable(late, False)
    board.suppressed = True
    w.demand("revenue")
    board.suppressed = False
    assert len(seen) == 2 and board.stats()["hooks"] == 2
    assert board.off(late) and not board.off(late) and board.clear("before_evaluate") == 1
    cancel = board.on("before_evaluate", lambda m: setattr(m, "cancelled", True), nodes=["revenue"])
    w.set("sales", rows(spark, 2))
    assert w.demand("revenue")["revenue"].first().v == 1  # the earlier table stays
    board.off(cancel)
    with pytest.raises(ValueError):
        board.on("someday", print)
    assert board.fire(Moment("error", None)).cancelled is False


def test_plugins(spark):
    board = HookBoard()
    log = EventLog()

    class Needs(Plugin):
        name, needs, tags = "needs", ("event_log",), frozenset({"t"})

    class Broken(Plugin):
        name = "broken"

        def load(self):
            raise OSError("no")

    class Ring(Plugin):
        name, needs = "ring", ("ring",)

    p = PluginBoard(board)
    for x in (log, Needs(), Broken(), Ring()):
        p.register(x)
    assert p.activate("needs") and p.names("active") == ["event_log", "needs"] and p.tagged("t") == ["needs"]
    assert not p.activate("broken") and p.state["broken"] == "error"
    with pytest.raises(RuntimeError):
        p.load("ring")
    w = bench(board)
    w.set("costs", rows(spark, 1))
    w.demand("spent")
    assert log.timing()["spent"]["count"] == 1 and log.table(spark).where("phase = 'after_evaluate'").count() == 1
    assert p.deactivate("event_log") and not board.of("after_evaluate")
    assert log.slow(0.0) and p.unregister("event_log") and p.get("event_log") is None
