import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import same_entries, short_checksum, truthy
from millrace.graph import Blueprint
from millrace.operators import values as V
from millrace.operators.windows import Trailing
from millrace.plans.evaluate import evaluate
from millrace.plans.validation import Checks


def one(df, build, *parents):
    g = Blueprint()
    for p in parents:
        g.source(p)
    g.derive("out", build, parents)
    return [r.out for r in evaluate(df, g, ["out"]).collect()]


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), ([1, 3, 5],), ([],), (None,)], "xs array<long>")
    assert one(df, V.map_each("xs", lambda x: x * 2), "xs") == [[2, 4, 6, 8, 10, 12], [2, 6, 10], [], None]
    assert one(df, V.keep_each("xs", lambda x: x % 2 == 0), "xs") == [[2, 4, 6], [], [], None]
    assert one(df, V.fold("xs", lambda a, x: a + x), "xs") == [21, 9, None, None]
    assert one(df, V.fold("xs", lambda a, x: a * 10 + x, F.lit(0).cast("long")), "xs")[1] == 135


def test_chain_and_pipeline(spark):
    g = Blueprint()
    g.source("x")
    V.map_chain(g, ["a", "b"], "x", [lambda x: x + 10, lambda x: x * 3])
    assert evaluate(spark.createDataFrame([(2,)], "x long"), g).first().b == 36
    with pytest.raises(ValueError):
        V.map_chain(g, ["c"], "x", [])
    df = spark.createDataFrame([(list(range(1, 11)),)], "xs array<long>")
    squares = F.filter(F.transform("xs", lambda x: x * x), lambda x: x > 25)
    assert one(df.select(squares.alias("xs")), V.fold("xs", lambda a, x: a + x), "xs") == [330]


def test_across_sources(spark):
    df = spark.createDataFrame([(10, 20, 30), (None, 4, 6), (None, None, None)], "a long, b long, c long")
    s = ["a", "b", "c"]
    assert one(df, V.total(s), *s) == [60, 10, None]
    assert one(df, V.mean(s), *s) == [20.0, 5.0, None]
    assert one(df, V.smallest(s), *s) == [10, 4, None]
    assert one(df, V.largest(s), *s) == [30, 6, None]
    assert one(df, V.count_known(s), *s) == [3, 2, None]
    assert one(df, V.product(s), *s) == [6000.0, 24.0, None]
    assert one(df, V.fold_sources(s, lambda x, y: x + y), *s)[0] == 60
    assert one(df, V.total(["a", "a"]), "a")[0] == 20
    assert one(df, V.combine(s, lambda c: F.coalesce(*c)), *s) == [10, 4, None]


def test_weighted(spark):
    df = spark.createDataFrame([(90, 80), (None, 80)], "exam long, homework long")
    got = one(df, V.weighted(["exam", "homework"], [0.7, 0.3]), "exam", "homework")
    assert got == [pytest.approx(87.0), pytest.approx(24.0)]
    assert one(df, V.weighted(["exam"], [0.0]), "exam") == [0.0, 0.0]
    with pytest.raises(ValueError):
        V.weighted(["exam"], [1.0, 2.0])


def test_conditionals(spark):
    df = spark.createDataFrame([(True, 1, 2), (False, 1, 2), (None, 1, 2)], "flag boolean, a long, b long")
    assert one(df, V.choose("flag", "a", "b", T.BooleanType()), "flag", "a", "b") == [1, 2, 2]
    temps = spark.createDataFrame([(105.0,), (100.0,), (99.0,), (None,), (math.nan,)], "t double")
    assert one(temps, V.threshold("t", 100, "OVERHEAT", "ok"), "t") == ["OVERHEAT", "OVERHEAT", "ok", "ok", "ok"]
    assert one(temps, V.choose_if("t", lambda t: t > 100, lambda t: -t, lambda t: F.lit(0.0)), "t")[:3] == [-105.0, 0.0, 0.0]
    modes = spark.createDataFrame([("fast", 100, 1), ("unknown", 100, 1), (None, 100, 1)], "mode string, f long, d long")
    assert one(modes, V.switch("mode", {"fast": "f"}, "d"), "mode", "f", "d") == [100, 1, 1]
    assert one(modes, V.switch("mode", {"fast": "f"}), "mode", "f") == [100, None, None]
    assert one(modes, V.switch_computed("mode", {"fast": lambda c: c["f"] * 2}, lambda c: F.lit(-1)), "mode", "f") == [200, -1, -1]


def test_truth(spark):
    df = spark.createDataFrame([(0.0, "", [], 0), (math.nan, "x", [1], 2), (None, None, None, None)], "d double, s string, a array<int>, i int")
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema.fields), strict=True))
    rows = df.select(*[truthy(F.col(c), k).alias(c) for c, k in kinds.items()]).collect()
    assert [list(r) for r in rows] == [[False] * 4, [True] * 4, [False] * 4]


def test_windows(spark):
    log = spark.createDataFrame([("k", i, v) for i, v in enumerate([10, 20, 30, 40])], "key string, seq long, v long")
    w = Trailing(["key"], ["seq"], 3)
    v = F.col("v")
    rows = log.select(w.mean(v).alias("m"), w.total(v).alias("t"), w.values(v).alias("xs"), w.evicted(v).alias("e"), w.filled().alias("n"), w.is_full().alias("full")).collect()
    assert [r.m for r in rows] == [10.0, 15.0, 20.0, 30.0]
    assert rows[3].xs == [20, 30, 40] and rows[3].e == 10 and rows[2].e is None
    assert [r.n for r in rows] == [1, 2, 3, 3] and [r.full for r in rows] == [False, False, True, True]
    spread = Trailing(["key"], ["seq"], 5).custom(v, lambda xs: F.array_max(xs) - F.array_min(xs))
    assert [r.s for r in log.select(spread.alias("s")).collect()] == [0, 10, 20, 30]
    with pytest.raises(ValueError):
        Trailing(["key"], ["seq"], 0)


def test_constraints(spark):
    df = spark.createDataFrame([(1, 72.0), (2, -50.0), (3, 151.0), (4, None), (5, math.nan)], "id long, t double")
    checks = Checks().between("t", -40, 150).holds("t", "round", lambda t: t % 1 == 0, "not whole")
    got = {(r.id, r.message) for r in checks.violations(df, ["id"]).collect()}
    assert {(2, "below -40"), (3, "above 150")} <= got and not any(i == 4 for i, _ in got)
    assert checks.of("t") == ["range", "round"] and checks.remove("t", "round") and not checks.remove("t", "round")
    strict = Checks().between("t", 0, allow_null=False)
    assert (4, "null is not allowed") in {(r.id, r.message) for r in strict.violations(df, ["id"]).collect()}
    assert Checks().violations(df, ["id"]).count() == 0
    typed = Checks().of_type("t", T.StringType).violations(df, ["id"])
    assert typed.count() == 4
    assert df.where(checks.row_is_valid()).count() == 2


def test_small_functions(spark):
    row = spark.range(1).select(
        same_entries(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("same"),
        short_checksum(F.lit(1), F.lit("put"), F.lit("k"), F.lit(None).cast("string")).alias("sum"),
    ).first()
    assert row.same and len(row.sum) == 8
