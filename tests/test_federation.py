import pytest
from pyspark.sql import functions as F

from millrace.graph import Blueprint
from millrace.plans import federation as D
from millrace.plans.evaluate import evaluate


def shop():
    g, h = Blueprint(), Blueprint()
    g.source("base")
    g.source("tax")
    g.derive("total", lambda c: c["base"] * (1 + c["tax"]), ["base", "tax"])
    h.source("price")
    h.source("quantity")
    h.derive("value", lambda c: c["price"] * c["quantity"], ["price", "quantity"])
    f = D.Federation()
    f.register("pricing", g)
    f.register("stock", h)
    f.bridge("pricing", "total", "stock", "price", lambda c: c * 0.9)
    return f


def test_merged_graph(spark):
    row = evaluate(
        spark.createDataFrame([(100.0, 0.1, 50.0)], "b double, t double, q double"),
        shop().merged(),
        ["stock::price", "stock::value"],
        bind={"pricing::base": F.col("b"), "pricing::tax": F.col("t"), "stock::quantity": F.col("q")},
    ).first()
    assert row["stock::price"] == pytest.approx(99.0) and row["stock::value"] == pytest.approx(4950.0)


def test_registry():
    f = shop()
    assert f.bridges_to("stock") == [("stock", "price")] == f.bridges_from("pricing")
    for bad in (("pricing", "zz", "stock", "price"), ("pricing", "total", "stock", "value"), ("stock", "value", "stock", "price"), ("none", "x", "stock", "price")):
        with pytest.raises(ValueError):
            f.bridge(*bad)
    with pytest.raises(ValueError):
        f.register("stock", Blueprint())
    assert f.unregister("pricing") and f.bridges_to("stock") == [] and not f.unregister("pricing")


def test_clocks(spark):
    m = lambda **k: F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for kv in k.items() for x in kv])
    row = spark.range(1).select(
        D.dominates(m(x=2, y=1), m(x=1, y=1)).alias("a"),
        D.concurrent(m(x=2, y=1), m(x=1, y=2)).alias("b"),
        D.concurrent(m(x=1), m(x=1)).alias("c"),
        D.dominates(m(x=1), m(z=1)).alias("d"),
        D.merged_clock(m(x=2, y=1), m(x=1, y=3)).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (True, True, True, False, {"x": 2, "y": 3})


@pytest.fixture
def book():
    b = D.SyncBook()
    b.register("source")
    b.register("target")
    b.record("target", "price")
    b.synchronize("target", "source", ["price"])
    b.record("source", "price")
    assert b.synchronize("source", "target", ["price"])[0] == "IN_SYNC"
    return b


def test_sync_windows(book):
    book.record("target", "quantity")
    book.record("source", "price")
    assert book.synchronize("source", "target", ["price"]) == ("IN_SYNC", {"price"}, set())
    assert book.state("source", "target") == "IN_SYNC" and book.mutation_count("target") == 2
    book.record("target", "price")
    book.record("source", "price")
    assert book.state("source", "target") == "DIVERGED"
    assert book.synchronize("source", "target", ["price", "tax"]) == ("DIVERGED", {"tax"}, {"price"})
    assert book.state("source", "nobody") == "UNKNOWN" and book.synchronize("x", "y", ["z"])[0] == "UNKNOWN"


def test_sync_table(spark):
    writes = spark.createDataFrame([(1, "t", "p"), (3, "t", "q"), (5, "t", "p")], "seq long, graph string, node string")
    syncs = spark.createDataFrame([(2, "s", "t", "p"), (4, "s", "t", "p"), (6, "s", "t", "p"), (6, "s", "t", "q")], "seq long, source string, target string, node string")
    assert {(r.seq, r.node) for r in D.sync_conflicts(writes, syncs).collect()} == {(2, "p"), (6, "p")}


def test_barrier():
    b = D.Barrier(frozenset({"a", "b"}))
    assert not b.arrive("a") and not b.arrive("zz") and b.pending == {"b"} and b.arrive("b")


def test_policies(spark):
    rows = spark.createDataFrame(
        [("l", 100, 90, 5, 3), ("f", 100, 90, 5, 3), ("h", 100, 150, 0, 0), ("w", 100, 150, 0, 0), ("r", 100, 150, 0, 0), ("m", 100, 200, 0, 0), ("l", 1, 2, 1, 1)],
        "node string, source_value long, target_value long, source_clock long, target_clock long",
    )
    policies = spark.createDataFrame([("f", "first_writer"), ("h", "highest"), ("w", "lowest"), ("r", "reject"), ("m", "merge")], "node string, policy string")
    done = D.resolve_conflicts(rows, policies, merge=lambda a, b: (a + b) / 2)
    assert sorted((r.node, r.value) for r in done.where("node <> 'r'").collect()) == [("f", 90), ("h", 150), ("l", 1), ("l", 100), ("m", 150), ("w", 100)]
    assert done.where("node = 'r'").first().value is None
    assert D.conflict_stats(done)["reject"] == {"n": 1, "rejected": 1}
    assert [r.node for r in D.frequent_conflicts(rows, 2).collect()] == ["l"]
