import pytest

from examples.applications import Build, Dashboard, recalculate, sheet


def test_spreadsheet(spark):
    got = recalculate(spark, {"price": 100.0, "tax_rate": 0.08, "quantity": 5.0})
    assert (got["unit_tax"], got["subtotal"], got["total"]) == (pytest.approx(8), 500, pytest.approx(540))


def test_build(spark):
    b = Build(spark, ["main.c", "util.c", "math.c"], "app")
    for name in ("main.c", "util.c", "math.c"):
        b.edit(name, f"int {name[0]};")
    assert set(b.run()) == {"main.o", "util.o", "math.o", "app"} and b.run() == []
    b.edit("util.c", "int u2;")
    assert b.run() == ["util.o", "app"]
    b.edit("util.c", "// a comment", "int u2;")
    assert b.run() == ["util.o"]


def test_dashboard(spark):
    d = Dashboard()
    d.widget("total", "total", "money")
    d.widget("tax", "unit_tax", "money")
    log = [("k", 1, "price", 100.0), ("k", 2, "tax_rate", 0.08), ("k", 3, "quantity", 5.0), ("k", 4, "price", 200.0)]
    df = spark.createDataFrame(log, "key string, seq long, input string, value double")
    assert d.follow(df, sheet(), ["key"], ["seq"]) == 4
    assert d.shown == {"total": pytest.approx(1080), "tax": pytest.approx(16)}
    assert d.subscriptions.pause("money") == 2
