"""Every query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.sql(SQL[name])
    want = rows(res.columns, res.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0
    assert set(SQL) <= set(entry.queries())
