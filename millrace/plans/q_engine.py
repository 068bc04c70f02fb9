"""Queries of the engine's own machinery: blueprints, schedules, workbench, channels, hooks, optimiser, stores of blueprints.

The blueprint is that of the tables of regions and nations, which have 5 and 25 rows at every size; what it is
applied to are the large tables.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.cli.__main__ import parse_values
from millrace.functions import cents
from millrace.functions.lineage import shared_folder
from millrace.graph import render
from millrace.graph.blueprint import Blueprint, CycleError
from millrace.plans import federation as D
from millrace.plans import optimize as O
from millrace.plans.catalogue import query
from millrace.plans.engine import Workbench
from millrace.plans.evaluate import evaluate
from millrace.plans.hooks import EventLog, HookBoard, Plugin, PluginBoard
from millrace.plans.validation import Checks
from millrace.sources.stores import Builders, ChangeLog, SnapshotStore, from_json, to_json
from millrace.sources.tables import table
from millrace.streaming.channel import Channel, Subscriptions, TaskQueue


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """Key and region of the nations, in order: 25 rows at every size."""
    return sorted((r[0], r[1]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())


def _zero(c):
    return F.lit(0)


def world(spark: SparkSession, sf_dir: str) -> Blueprint:
    """Regions, the nations that depend on them, and a sum of all nations."""
    g, nations = Blueprint(), _nations(spark, sf_dir)
    for r in sorted({r for _, r in nations}):
        g.source(f"r:{r}")
    for n, r in nations:
        g.derive(f"n:{n}", lambda c, r=r: c[f"r:{r}"] + 1, [f"r:{r}"], priority=n % 3)
    g.derive("all", lambda c: functools.reduce(lambda a, b: a + b, c.values()), [f"n:{n}" for n, _ in nations])
    return g


_WORLD = """w AS (SELECT DISTINCT 'r:' || n_regionkey AS node_id, 'source' AS kind, 0 AS priority FROM nation
UNION ALL SELECT 'n:' || n_nationkey, 'derived', CAST(n_nationkey % 3 AS INT) FROM nation UNION ALL SELECT 'all', 'derived', 0),
e AS (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n:' || n_nationkey, 'all' FROM nation)"""


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"WITH {_WORLD} SELECT node_id, kind, priority, (SELECT count(*) FROM e WHERE dst = node_id) AS n_parents, (SELECT count(*) FROM e WHERE src = node_id) AS n_children, (SELECT count(*) FROM w) AS n_nodes FROM w")
def blueprint_catalogue(spark, sf_dir):
    """Every node, looked up by its name, with its degrees."""
    g = world(spark, sf_dir)
    rows = []
    for n in [*g.sources, *g.derived]:
        node = g.node(n)
        rows.append((n, "source" if node.is_source else "derived", node.priority, len(g.parents(n)), len(g.children(n)), len(g)))
    return _rows(spark, rows, "node_id string, kind string, priority int, n_parents long, n_children long, n_nodes long")


@query(f"""WITH {_WORLD} SELECT src, dst FROM e WHERE src <> 'r:0' UNION SELECT 'r:' || (n_regionkey + 1) % 5, 'n:' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND (n_regionkey + 1) % 5 <> 0""")
def blueprint_edges_after_surgery(spark, sf_dir):
    """Even nations get the next region as one more parent, a cycle is refused, and region 0 is removed."""
    g = world(spark, sf_dir)
    for n, r in _nations(spark, sf_dir):
        if n % 2 == 0:
            g.link(f"r:{(r + 1) % 5}", f"n:{n}")
    try:
        g.link("all", "n:1")
        raise AssertionError("a cycle was closed")
    except CycleError:
        pass
    g.remove("r:0")
    return g.tables(spark)[1]


@query(f"WITH {_WORLD} SELECT node_id AS reached FROM w WHERE node_id = 'all' UNION ALL SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey = 2")
def blueprint_reaches(spark, sf_dir):
    """What region 2 reaches, node by node."""
    g = world(spark, sf_dir)
    return _rows(spark, [(n,) for n in g.names if g.reaches("r:2", n)], "reached string")


@query(f"WITH {_WORLD} SELECT node_id, row_number() OVER (ORDER BY node_id = 'all', priority, node_id) - 1 AS place FROM w WHERE kind = 'derived'")
def schedule_full(spark, sf_dir):
    g = world(spark, sf_dir)
    return _rows(spark, [(n, i) for i, n in enumerate(g.schedule())], "node_id string, place long")


@query(f"WITH {_WORLD} SELECT node_id, row_number() OVER (ORDER BY priority, node_id) - 1 AS place FROM w WHERE node_id IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def schedule_selected(spark, sf_dir):
    """The nations of two regions, the node above them left out."""
    g = world(spark, sf_dir)
    return _rows(spark, [(n, i) for i, n in enumerate(g.schedule(g.downstream("r:1", "r:3") - {"all"}))], "node_id string, place long")


@query("SELECT 'n:' || n_nationkey AS node_id FROM nation UNION ALL SELECT DISTINCT 'r:' || n_regionkey FROM nation")
def demand_required_ancestors(spark, sf_dir):
    return _rows(spark, [(n,) for n in world(spark, sf_dir).upstream("all")], "node_id string")


_STALE = "SELECT 'n:' || n_nationkey AS node_id FROM nation WHERE n_regionkey <> 4 AND n_regionkey + 2 > n_nationkey % 5"


@query(f"WITH s AS ({_STALE}) SELECT node_id FROM s UNION ALL SELECT 'all' WHERE EXISTS (SELECT 1 FROM s WHERE CAST(substr(node_id, 3) AS INT) % 4 > 1)")
def invalidate_selective(spark, sf_dir):
    """Regions but the last changed; a nation is stale where its region's generation has passed the one that it saw."""
    g, nations = world(spark, sf_dir), _nations(spark, sf_dir)
    now = {f"r:{r}": r + 2 for _, r in nations} | {f"n:{n}": n % 4 for n, _ in nations}
    seen = {f"n:{n}": {f"r:{r}": n % 5} for n, r in nations} | {"all": {f"n:{n}": 1 for n, _ in nations}}
    stale = g.stale_after([f"r:{r}" for r in range(4)], seen, now)
    return _rows(spark, [(n,) for n in stale], "node_id string")


# --- the workbench: balances and orders by nation as tables ---------------------------------------------------


def bench(spark: SparkSession, sf_dir: str, hooks: HookBoard | None = None) -> Workbench:
    g = Blueprint()
    g.source("customer")
    g.source("orders")
    g.derive("balance", lambda t: t["customer"].groupBy("c_nationkey").agg(F.sum(cents(F.col("c_acctbal"))).alias("cents")), ["customer"])
    g.derive("rich", lambda t: t["balance"].where("cents > 0").select("c_nationkey"), ["balance"])
    sold = lambda t: t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    g.derive("sold", sold, ["customer", "orders"])
    w = Workbench(g, hooks)
    w.set("customer", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    w.set("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return w


_BALANCE = "SELECT 'balance' AS node_id, CAST(c_nationkey AS BIGINT) AS nation, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS value FROM customer GROUP BY c_nationkey"
_SOLD = "SELECT 'sold' AS node_id, CAST(c_nationkey AS BIGINT) AS nation, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey {} GROUP BY c_nationkey"


def _values(name: str, df: DataFrame, column: str) -> DataFrame:
    return df.select(F.lit(name).alias("node_id"), F.col("c_nationkey").cast("long").alias("nation"), F.col(column).cast("long").alias("value"))


@query(f"{_BALANCE} UNION ALL {_SOLD.format('')}")
def demand_multiple(spark, sf_dir):
    got = bench(spark, sf_dir).demand("balance", "sold")
    return _values("balance", got["balance"], "cents").union(_values("sold", got["sold"], "n"))


@query(f"{_BALANCE}")
def memo_get(spark, sf_dir):
    """The kept table, without a demand, after its source went on."""
    w = bench(spark, sf_dir)
    w.demand("balance")
    w.set("customer", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal")))
    return _values("balance", w.memo("balance"), "cents")


@query(
    """SELECT * FROM (VALUES ('first demand', 'balance,rich,sold', '', 5), ('again', '', 'balance,rich,sold', 5), ('one evicted', 'rich', 'balance,sold', 5), ('cleared', 'balance,rich,sold', '', 5),
('orders changed', 'sold', 'balance,rich', 5), ('same rows set', '', 'balance,rich,sold', 5)) AS t(step, evaluated, reused, size)"""
)
def memo_life(spark, sf_dir):
    """What a workbench computes and what it reuses, step by step."""
    w, rows = bench(spark, sf_dir), []

    def step(name: str) -> None:
        w.demand("rich", "sold")
        rows.append((name, ",".join(sorted(w.report.evaluated)), ",".join(sorted(w.report.reused)), len(w)))

    step("first demand")
    step("again")
    w.evict("rich")
    step("one evicted")
    w.clear()
    step("cleared")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    w.set("orders", orders.where("o_orderstatus <> 'P'"))
    step("orders changed")
    w.set("orders", orders.where("not o_orderstatus = 'P'"))
    step("same rows set")
    return _rows(spark, rows, "step string, evaluated string, reused string, size int")


@query(
    """SELECT * FROM (VALUES ('customer', 'CLEAN', 2, ''), ('orders', 'CLEAN', 1, ''), ('balance', 'DIRTY', 1, 'customer=1'), ('rich', 'DIRTY', 1, 'balance=1'), ('sold', 'CLEAN', 2, 'customer=2,orders=1')) AS t(node_id, state, generation, seen)"""
)
def memo_states(spark, sf_dir):
    """After a change of customers and a demand of one node only: states, generations, and what each table was computed from."""
    w = bench(spark, sf_dir)
    w.demand("rich", "sold")
    w.set("customer", table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal"))
    w.demand("sold")
    states = w.states()
    rows = [(n, states[n], w.generation(n), ",".join(f"{p}={k}" for p, k in sorted(w.seen(n).items()))) for n in w.graph.names]
    return _rows(spark, rows, "node_id string, state string, generation int, seen string")


@query(f"{_BALANCE.replace('FROM customer', 'FROM customer WHERE c_acctbal > 0')} UNION ALL {_SOLD.format('''WHERE c_acctbal > 0 AND o_orderstatus = 'F' ''')}")
def transaction_commit(spark, sf_dir):
    """Two sources are set in one transaction and count together at its end."""
    w = bench(spark, sf_dir)
    with w.transaction("balance", "sold"):
        w.set("customer", table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal"))
        w.set("orders", table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus"))
        assert w.generation("customer") == 1
    return _values("balance", w.memo("balance"), "cents").union(_values("sold", w.memo("sold"), "n"))


@query(f"{_BALANCE}")
def transaction_rollback(spark, sf_dir):
    """An exception takes everything back, what was computed in between included."""
    w = bench(spark, sf_dir)
    w.demand("balance")
    try:
        with w.transaction():
            w.set("customer", table(spark, sf_dir, "customer").limit(0).select("c_custkey", "c_nationkey", "c_acctbal"))
            raise KeyError("something else")
    except KeyError:
        pass
    return _values("balance", w.demand("balance")["balance"], "cents")


@query(f"{_BALANCE}")
def checkpoint_restore(spark, sf_dir):
    """The state at a checkpoint comes back, and no longer once it is discarded."""
    w = bench(spark, sf_dir)
    w.demand("balance")
    before = w.checkpoint()
    w.set("customer", table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal"))
    w.demand("balance")
    before.restore()
    assert w.generation("customer") == 1 and w.is_valid("balance")
    before.discard()
    try:
        before.restore()
        raise AssertionError("restored from nothing")
    except RuntimeError:
        return _values("balance", w.memo("balance"), "cents")


@query("SELECT * FROM (VALUES ('balance', 3, TRUE), ('sold', 1, FALSE)) AS t(node_id, n, hottest_first)")
def profile_counts(spark, sf_dir):
    """How often nodes were computed, and that the seconds add up."""
    w = bench(spark, sf_dir)
    for k in range(3):
        w.set("customer", table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 2000 * k).select("c_custkey", "c_nationkey", "c_acctbal"))
        got = w.profile("balance")
        assert got["balance"]["count"] == k + 1 and got["balance"]["total"] >= got["balance"]["seconds"]
    w.profile("sold")
    assert abs(w.total_seconds - sum(w.spent.values())) < 1e-9 and [n for n, _ in w.hotspots(1)] == [max(w.spent, key=w.spent.get)]
    return _rows(spark, [(n, w.invocations[n], n == "balance") for n in ("balance", "sold")], "node_id string, n int, hottest_first boolean")


# --- channels, subscriptions, deferred work -------------------------------------------------------------------

_N = "n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS k, count(*) OVER () AS total FROM nation)"


def _feed(channel: Channel, nations: list[tuple[int, int]]) -> None:
    for n, r in nations:
        channel.emit({f"r:{r}": n})


@query(
    f"""WITH {_N}, m AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS j, count(*) OVER () AS mine FROM n WHERE n_regionkey IN (1, 2, 4))
SELECT 'value' AS kind, 'r:' || n_regionkey AS node, CAST(n_nationkey AS VARCHAR) AS value, CAST(mine - 7 AS INT) AS dropped FROM m WHERE j > mine - 7
UNION ALL SELECT 'error', 'r:1', 'broken', CAST((SELECT any_value(mine) FROM m) - 7 AS INT) UNION ALL SELECT 'complete', '', NULL, CAST((SELECT any_value(mine) FROM m) - 7 AS INT)"""
)
def channel_delivery(spark, sf_dir):
    """Seven places for what comes while paused, the oldest going first; then an error, the end, and nothing after it."""
    heard, channel = [], Channel(7, "oldest")
    channel.observe("r:1", "r:2", "r:3", "r:4")
    channel.unobserve("r:3")
    number = channel.subscribe(lambda e: heard.append((e.kind, e.node, None if e.value is None else str(e.value))))
    channel.pause()
    _feed(channel, _nations(spark, sf_dir))
    channel.resume()
    channel.emit_error("r:1", ValueError("broken"))
    channel.complete()
    channel.emit({"r:1": 99})
    assert channel.unsubscribe(number) and not channel.unsubscribe(number)
    return _rows(spark, [(*h, channel.dropped) for h in heard], "kind string, node string, value string, dropped int")


@query(f"WITH {_N} SELECT 'r:' || n_regionkey AS node, n_nationkey AS value FROM n WHERE k <= 5")
def channel_drain(spark, sf_dir):
    """Five places and newcomers refused; what waits is taken out without being delivered."""
    channel = Channel(5, "newest")
    channel.observe(*(f"r:{r}" for r in range(5)))
    channel.subscribe(lambda e: (_ for _ in ()).throw(AssertionError("delivered")))
    channel.pause()
    _feed(channel, _nations(spark, sf_dir))
    assert channel.pending == 5
    return _rows(spark, [(e.node, e.value) for e in channel.drain()], "node string, value int")


@query(
    f"""WITH {_N}, a AS (SELECT *, k <= total // 3 AS first, k > total // 3 AND k <= 2 * (total // 3) AS second, k > 2 * (total // 3) AS third FROM n)
SELECT 'all' AS name, 'g1' AS grp, 'active' AS state, count(*) FILTER (first OR third) AS delivered FROM a
UNION ALL SELECT 'even', 'g1', 'active', count(*) FILTER ((first OR third) AND n_nationkey % 2 = 0) FROM a
UNION ALL SELECT 'gone', 'g2', 'disposed', count(*) FILTER (first OR second) FROM a"""
)
def subscription_life(spark, sf_dir):
    """Two groups: the first is paused for the middle third of what comes, the second is disposed of after it."""
    channel, subs, nations = Channel(), Subscriptions(), _nations(spark, sf_dir)
    channel.observe(*(f"r:{r}" for r in range(5)))
    named = {
        "all": subs.subscribe(channel, lambda e: None, "g1"),
        "even": subs.subscribe(channel, lambda e: None, "g1", lambda e: e.value % 2 == 0),
        "gone": subs.subscribe(channel, lambda e: None, "g2"),
    }
    third = len(nations) // 3
    _feed(channel, nations[:third])
    assert subs.pause("g1") == 2
    _feed(channel, nations[third : 2 * third])
    assert subs.resume("g1") == 2 and subs.dispose("g2") == 1
    _feed(channel, nations[2 * third :])
    rows = [(n, s.group, s.state, s.delivered) for n, s in named.items()]
    assert subs.cleanup() == 1 and not subs.unsubscribe(named["gone"].id) and subs.dispose() == 2
    return _rows(spark, rows, "name string, grp string, state string, delivered long")


_TASKS = """t AS (SELECT 'n:' || n_nationkey AS node, CASE n_nationkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END AS priority, n_nationkey % 5 AS delay, row_number() OVER (ORDER BY n_nationkey) AS seq FROM nation),
one AS (SELECT *, row_number() OVER (ORDER BY priority, seq) AS k FROM t WHERE delay <= 2), two AS (SELECT * FROM one WHERE k <= 6),
rest AS (SELECT node, row_number() OVER (ORDER BY priority, seq) AS k FROM t WHERE node NOT IN (SELECT node FROM two))"""


@query(f"WITH {_TASKS} SELECT 1 AS tick, node, CAST(k AS INT) AS place FROM two UNION ALL SELECT 2, node, CAST(k AS INT) FROM rest")
def task_queue_ticks(spark, sf_dir):
    """A tick takes at most six ready tasks by priority and order, the next one all that is left."""
    done, number = [], [0]

    def work(nodes):
        done.extend((number[0], n, i + 1) for i, n in enumerate(nodes))
        return {n: n for n in nodes}

    told = []
    queue, nations = TaskQueue(work), _nations(spark, sf_dir)
    queue.on_complete(lambda name, value: told.append(name))
    for n, _ in nations:
        queue.schedule(f"n:{n}", (10, 20, 30)[n % 3], float(n % 5), now=0.0)
    assert not queue.schedule("n:0", 30, 0.0, now=0.0) and queue.peek() == "n:0" and len(queue) == len(nations)
    number[0] = 1
    queue.tick(6, now=2.0)
    number[0] = 2
    queue.tick(now=100.0)
    assert queue.processed == len(told) == len(nations) and len(queue) == 0
    return _rows(spark, done, "tick int, node string, place int")


@query("SELECT count(*) AS scheduled, CAST(count(*) * 10.0 / count(*) AS DOUBLE) AS average_wait, CAST(count(*) FILTER (n_nationkey % 2 = 0) AS BIGINT) AS cancelled FROM nation")
def task_queue_waits(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    queue, other = TaskQueue(lambda nodes: {}), TaskQueue(lambda nodes: {})
    n = queue.schedule_all([f"n:{k}" for k, _ in nations], now=0.0)
    queue.tick(now=10.0)
    other.schedule_all([f"n:{k}" for k, _ in nations], now=0.0)
    gone = sum(other.cancel(f"n:{k}") for k, _ in nations if k % 2 == 0)
    assert other.cancel_all() == len(nations) - gone
    return _rows(spark, [(n, queue.average_wait, gone)], "scheduled long, average_wait double, cancelled long")


# --- hooks and plugins ----------------------------------------------------------------------------------------


@query(
    """SELECT * FROM (VALUES ('after_evaluate:balance', 1), ('after_evaluate:rich', 1), ('after_propagate:', 3), ('before_evaluate:balance', 1), ('before_evaluate:rich', 1), ('before_propagate:', 3), ('cut_off:rich', 1), ('after_evaluate:balance 2', 1)) AS t(moment, n)"""
)
def hooks_fired(spark, sf_dir):
    """Three demands: the first computes, the second reuses, the third finds a node's rows unchanged; hooks of suppressed, disabled or removed kinds are silent."""
    hooks, seen = HookBoard(), []
    note = lambda m: seen.append(f"{m.phase}:{m.node or ''}")
    for phase in ("before_propagate", "after_propagate", "after_evaluate", "cut_off"):
        hooks.on(phase, note)
    once = hooks.on("before_evaluate", note, nodes=["balance", "rich"])
    gone, off = hooks.on("after_evaluate", lambda m: seen.append("never")), hooks.on("after_evaluate", lambda m: seen.append("never"))
    hooks.off(gone)
    hooks.enable(off, False)
    w = bench(spark, sf_dir, hooks)
    w.demand("rich")
    w.demand("rich")
    hooks.enable(once, False)
    # all balances rise, but no nation becomes rich or poor by it
    w.set("customer", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") * 2).alias("c_acctbal")))
    w.demand("rich")
    hooks.suppressed = True
    w.clear()
    w.demand("rich")
    counts: dict[str, int] = {}
    for s in seen:
        counts[s] = counts.get(s, 0) + 1
    assert hooks.stats()["fired"][off] == 0 and len(hooks.of("cut_off")) == 1
    counts["after_evaluate:balance 2"] = counts["after_evaluate:balance"] - 1
    counts["after_evaluate:balance"] = 1
    assert hooks.clear("cut_off") == 1 and hooks.clear() > 0
    return _rows(spark, list(counts.items()), "moment string, n int")


class _Base(Plugin):
    name, tags = "base", frozenset(["core"])

    def activate(self, hooks):
        return [hooks.on("after_evaluate", lambda m: None)]


class _Extra(Plugin):
    name, needs, tags = "extra", ("base",), frozenset(["core", "more"])


class _Broken(Plugin):
    name = "broken"

    def load(self):
        raise OSError("no such file")


@query(
    """SELECT * FROM (VALUES ('registered', 'base', 'registered'), ('registered', 'broken', 'registered'), ('registered', 'extra', 'registered'), ('activated', 'base', 'active'), ('activated', 'broken', 'error'), ('activated', 'extra', 'active'),
('unloaded', 'base', 'active'), ('unloaded', 'broken', 'error'), ('unloaded', 'extra', 'registered'), ('unregistered', 'base', 'active'), ('unregistered', 'extra', 'registered')) AS t(step, plugin, state)"""
)
def plugin_life(spark, sf_dir):
    hooks = HookBoard()
    board, rows = PluginBoard(hooks), []
    step = lambda name: rows.extend((name, n, board.state[n]) for n in board.names())
    for p in (_Extra(), _Base(), _Broken()):
        board.register(p)
    step("registered")
    assert board.activate("extra") and not board.activate("broken")
    step("activated")
    assert board.unload("extra") and board.tagged("core") == ["base", "extra"] and board.names("error") == ["broken"]
    step("unloaded")
    assert board.unregister("broken") and board.get("broken") is None and len(hooks.of("after_evaluate")) == 1
    step("unregistered")
    return _rows(spark, rows, "step string, plugin string, state string")


@query("SELECT * FROM (VALUES ('after_evaluate', 'balance', 1), ('after_evaluate', 'rich', 1), ('after_propagate', NULL, 1), ('before_propagate', NULL, 1)) AS t(phase, node, n)")
def event_log(spark, sf_dir):
    """The log of a demand at level info, with the times of its nodes."""
    hooks, log = HookBoard(), EventLog()
    board = PluginBoard(hooks)
    board.register(log)
    board.activate("event_log")
    bench(spark, sf_dir, hooks).demand("rich")
    timing = log.timing()
    assert set(timing) == {"balance", "rich"} and all(t["count"] == 1 and t["max"] == t["total"] for t in timing.values())
    assert len(log.slow(0.0)) == 4 and not log.slow(1e9)
    return log.table(spark).groupBy("phase", "node").agg(F.count("*").cast("int").alias("n"))


# --- optimiser: a blueprint over orders, before and after it is rewritten ------------------------------------


def priced() -> Blueprint:
    g = Blueprint()
    g.source("price")
    g.source("unused")
    for name, parent, fn in (("a", "price", lambda c: c + 1), ("b", "a", lambda c: c * 3), ("c", "b", lambda c: c - 7), ("x", "price", lambda c: c % 11), ("y", "x", lambda c: c * c), ("dead", "unused", lambda c: c)):
        g.derive(name, lambda v, parent=parent, fn=fn: fn(v[parent]), [parent])
    g.derive("out", lambda v: v["c"] - v["y"], ["c", "y"])
    return g


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("price"))


@query("WITH p AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders) SELECT o_orderkey, (price + 1) * 3 - 7 - (price % 11) * (price % 11) AS out FROM p")
def opt_fused_values(spark, sf_dir):
    """Fused and pruned, the blueprint gives what it gave, from fewer nodes."""
    g = O.prune(O.fuse(priced(), outputs=["out"]), ["out"])
    assert sorted(g.names) == ["c", "out", "price", "y"]
    return evaluate(_prices(spark, sf_dir), g, ["out"], keep=["o_orderkey", "price"]).drop("price")


@query("SELECT * FROM (VALUES ('a,b,c', 3, 0.002::DOUBLE), ('x,y', 2, 0.001::DOUBLE)) AS t(nodes, n, saving)")
def opt_fusable(spark, sf_dir):
    """The chains that would be fused, and the seconds that is taken to save."""
    chains = O.fusable(priced(), ["out"])
    return _rows(spark, [(",".join(c.nodes), len(c.nodes), c.saving) for c in chains], "nodes string, n int, saving double")


@query("SELECT * FROM (VALUES ('price', TRUE, NULL), ('unused', FALSE, 'no output needs it'), ('a', TRUE, NULL), ('b', TRUE, NULL), ('c', TRUE, NULL), ('x', TRUE, NULL), ('y', TRUE, NULL), ('dead', FALSE, 'no output needs it'), ('out', TRUE, NULL)) AS t(node_id, live, why)")
def opt_liveness(spark, sf_dir):
    g = priced()
    why = O.why_dead(g, ["out"])
    assert O.idle_subgraphs(g, ["out"]) == [frozenset(["unused", "dead"])] and O.dead(g, ["out"], preserve=["dead"]) == set()
    return _rows(spark, [(n, live, why.get(n)) for n, live in O.liveness(g, ["out"]).items()], "node_id string, live boolean, why string")


_COST = """c AS (SELECT 'n:' || n_nationkey AS node_id, CASE WHEN n_nationkey % 5 = 0 THEN (n_nationkey + 1) / 2.0::DOUBLE ELSE 0.001::DOUBLE + 0.0005::DOUBLE END AS seconds,
  CASE WHEN n_nationkey % 2 = 0 THEN 2048.0::DOUBLE * (n_nationkey + 1) ELSE 1536.0::DOUBLE END AS bytes, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE 0 END AS io FROM nation),
t AS (SELECT *, seconds + 0.001::DOUBLE * bytes / 1024.0::DOUBLE + 0.1::DOUBLE * io + 0.05::DOUBLE + 0.02::DOUBLE AS total FROM c)"""


@query(f"WITH {_COST} SELECT node_id, round(total, 9) AS total, total > 1.0 AS is_expensive, 0.1::DOUBLE * io / greatest(total, 0.001::DOUBLE) > 0.5 AS is_io_bound, CASE WHEN round(total, 9) > round((SELECT total FROM t WHERE node_id = 'n:3'), 9) THEN 1 WHEN round(total, 9) < round((SELECT total FROM t WHERE node_id = 'n:3'), 9) THEN -1 ELSE 0 END AS against_n3 FROM t")
def cost_of_nodes(spark, sf_dir):
    """Costs with what was measured and noted: seconds of every fifth nation, bytes of every second, reads of every third."""
    g, nations = world(spark, sf_dir), _nations(spark, sf_dir)
    model = O.CostModel(g)
    for n, _ in nations:
        if n % 5 == 0:
            for seconds in (n, 1.0):
                model.record(f"n:{n}", seconds)
        if n % 2 == 0:
            model.annotate(f"n:{n}", memory=2048 * (n + 1))
        if n % 3 == 0:
            model.annotate(f"n:{n}", io=n)
    rows = [(f"n:{n}", round(model.of(f"n:{n}").total, 9), model.of(f"n:{n}").is_expensive, model.of(f"n:{n}").is_io_bound, model.compare(f"n:{n}", "n:3")) for n, _ in nations]
    assert model.profile()["critical_path"] >= max(r[1] for r in rows) and model.ranked()[0][1] >= model.ranked()[-1][1]
    return _rows(spark, rows, "node_id string, total double, is_expensive boolean, is_io_bound boolean, against_n3 int")


@query("SELECT CAST(count(*) + 1 AS DOUBLE) / 2 AS speedup, count(*) AS width, 2 AS critical_path, CAST(ceil(count(*) / 10.0) + 1 AS BIGINT) AS stages FROM nation")
def opt_stages(spark, sf_dir):
    plan = O.partition(world(spark, sf_dir), widest=10)
    return _rows(spark, [(plan.speedup, max(plan.profile()), plan.critical_path, len(plan.stages))], "speedup double, width long, critical_path int, stages long")


# --- stored blueprints, snapshots, change logs, rendering ------------------------------------------------------


@query(f"WITH {_WORLD} SELECT node_id, kind, priority FROM w")
def stored_blueprint(spark, sf_dir):
    """To JSON and back, builders by their registered names."""
    g, builders = world(spark, sf_dir), Builders()
    for n in g.derived:
        builders.register(f"build {n}", g.node(n).build)
    back, generations = from_json(to_json(g, builders, {"all": 3}), builders)
    assert generations == {"all": 3} and back.schedule() == g.schedule()
    return back.tables(spark)[0]


@query("SELECT c_nationkey AS key, 'balance' AS node_id, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) AS value FROM customer GROUP BY c_nationkey")
def stored_snapshots(spark, sf_dir):
    """Two snapshots are saved, listed in order, one is deleted, the other read."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/snapshots-{spark.sparkContext.applicationId}-{id(object())}")
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.sum(cents(F.col("c_acctbal"))).cast("double").alias("value"))
    snapshot = rows.select("key", F.lit("balance").alias("node_id"), "value")
    for name in ("first", "second"):
        if name in store.names():
            store.delete(name)
        store.save(name, snapshot if name == "second" else snapshot.limit(0))
    assert sorted(store.names()) == ["first", "second"] and store.delete("first") and not store.delete("first") and len(store) == 1
    return store.get("second").select("key", "node_id", "value")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS seq, 'r:' || n_regionkey AS input, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def recorded_changes(spark, sf_dir):
    """A change log recorded on the driver, kept as a list, read back, and as a table."""
    g = world(spark, sf_dir)
    log = ChangeLog(g)
    log.start()
    for n, r in _nations(spark, sf_dir):
        log.record(f"r:{r}", float(n))
    log.stop()
    again = ChangeLog.from_list(json.loads(json.dumps(log.to_list())), g)
    assert len(again.of("r:0")) == sum(r == 0 for _, r in _nations(spark, sf_dir))
    return again.table(spark).select("seq", "input", "value")


@query(f"""WITH {_WORLD} SELECT '  "' || src || '" -> "' || dst || '";' AS line FROM e UNION ALL SELECT '  "' || node_id || '" [label="' || node_id || '", shape=' || CASE kind WHEN 'source' THEN 'box' ELSE 'ellipse' END || ', style=filled, fillcolor=white];' FROM w
UNION ALL SELECT unnest(['digraph blueprint {{', '  rankdir=LR;', '}}'])""")
def render_dot(spark, sf_dir):
    return _rows(spark, [(x,) for x in render.dot(world(spark, sf_dir)).split("\n")], "line string")


@query("SELECT '  \"n:' || n_nationkey || '\" -> \"all\";' AS line FROM nation WHERE n_regionkey = 3 UNION ALL SELECT '  \"r:3\" -> \"n:' || n_nationkey || '\";' FROM nation WHERE n_regionkey = 3")
def render_subgraph(spark, sf_dir):
    """The edges below one region."""
    lines = render.dot(render.below(world(spark, sf_dir), "r:3")).split("\n")
    return _rows(spark, [(x,) for x in lines if " -> " in x], "line string")


@query("SELECT 'r:' || n_regionkey AS id, 'source' AS kind, '' AS parents FROM nation GROUP BY n_regionkey UNION ALL SELECT 'n:' || n_nationkey, 'derived', 'r:' || n_regionkey FROM nation")
def render_json(spark, sf_dir):
    nodes = json.loads(render.as_json(world(spark, sf_dir)))["nodes"]
    return _rows(spark, [(n["id"], n["kind"], ",".join(n["parents"])) for n in nodes if n["id"] != "all"], "id string, kind string, parents string")


@query("SELECT * FROM (VALUES ('a', '1', 'int'), ('b', '2.5', 'float'), ('c', 'x=y', 'str'), ('d', '', 'str')) AS t(name, value, kind)")
def cli_values(spark, sf_dir):
    got = parse_values(["a=1", "b=2.5", "c=x=y", "d="])
    return _rows(spark, [(k, str(v), type(v).__name__) for k, v in got.items()], "name string, value string, kind string")


# --- federation -----------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('from extract', 'load', 'raw'), ('from extract', 'transform', 'amount'), ('from extract', 'transform', 'is_bulk'), ('to load', 'load', 'raw'), ('to load', 'load', 'value'), ('nodes', 'transform', '5'), ('left', 'load', 'value')) AS t(what, space, node)")
def fed_bridges(spark, sf_dir):
    """What goes out of and into a graph of a federation, a graph looked up, and what is left without one."""
    from millrace.plans.q_federation import three_graphs

    f = three_graphs()
    rows = [("from extract", *b) for b in f.bridges_from("extract")] + [("to load", *b) for b in f.bridges_to("load")]
    rows.append(("nodes", "transform", str(len(f.endpoint("transform")))))
    assert f.unregister("extract") and not f.unregister("extract")
    rows += [("left", *b) for b in sorted(f.bridges)]
    return _rows(spark, rows, "what string, space string, node string")


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') + 1 AS click, count(*) FILTER (event_type = 'purchase') AS purchase
FROM events GROUP BY user_id"""
)
def vclock_merge(spark, sf_dir):
    """Each event has its user's clock so far; all of a user's clocks merged, then one more click."""
    from pyspark.sql.window import Window

    names = ["view", "click", "purchase"]
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    clock = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.count_if(F.col("event_type") == n).over(so_far) for n in names]))
    merged = D.merged_clocks(table(spark, sf_dir, "events").select("user_id", clock.alias("clock")), ["user_id"])
    more = D.incremented(F.col("clock"), F.lit("click"))
    return merged.select("user_id", more.alias("clock")).select("user_id", *[F.element_at("clock", n).alias(n) for n in names])


@query("SELECT * FROM (VALUES ('unknown', 'UNKNOWN', 0, ''), ('never synced', 'STALE', 3, ''), ('synced', 'IN_SYNC', 3, ''), ('written on', 'STALE', 4, ''), ('written on both sides', 'DIVERGED', 4, ''), ('synced with a conflict', 'DIVERGED', 4, 'x'), ('barrier', 'False', 0, 'b'), ('barrier again', 'True', 0, '')) AS t(step, state, writes, nodes)")
def sync_states(spark, sf_dir):
    """The states that two graphs go through, and a barrier."""
    book, rows = D.SyncBook(), []
    rows.append(("unknown", book.state("a", "b"), 0, ""))
    book.register("b")
    for node in "xyz":
        book.record("a", node)
    rows.append(("never synced", book.state("a", "b"), book.mutation_count("a"), ""))
    book.synchronize("a", "b", "xyz")
    rows.append(("synced", book.state("a", "b"), book.mutation_count("a"), ""))
    book.record("a", "x")
    rows.append(("written on", book.state("a", "b"), book.mutation_count("a"), ""))
    book.record("b", "x")
    rows.append(("written on both sides", book.state("a", "b"), book.mutation_count("a"), ""))
    state, _, conflicts = book.synchronize("a", "b", "xz")
    rows.append(("synced with a conflict", state, book.mutation_count("a"), ",".join(sorted(conflicts))))
    barrier = D.Barrier(frozenset("ab"))
    rows.append(("barrier", str(barrier.arrive("a")), 0, ",".join(barrier.pending)))
    barrier.arrive("c")
    rows.append(("barrier again", str(barrier.arrive("b")), 0, ",".join(barrier.pending)))
    return _rows(spark, rows, "step string, state string, writes int, nodes string")


# --- constraints ----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'c_acctbal' AS node_id, 'poor' AS "constraint", 'below 0.0' AS message, 'c_acctbal:poor;c_name:named' AS registered FROM customer WHERE c_acctbal < 0""")
def validate_registry(spark, sf_dir):
    """Three constraints are registered and one is removed again."""
    checks = Checks().between("c_acctbal", low=0.0, name="poor").between("c_acctbal", high=0.0, name="rich").holds("c_name", "named", lambda c: F.length(c) > 0, "no name")
    assert checks.remove("c_acctbal", "rich") and not checks.remove("c_acctbal", "rich")
    left = ";".join(f"{n}:{','.join(checks.of(n))}" for n in checks.nodes)
    return checks.violations(table(spark, sf_dir, "customer"), ["c_custkey"]).withColumn("registered", F.lit(left))
