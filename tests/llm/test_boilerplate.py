import collections

from millrace.llm import boilerplate as P
from millrace.llm.common import prepare
from tests.llm.util import documents


def brute(rows):
    """rows: (doc_id, text, source)"""
    total, n = collections.Counter(), collections.Counter()
    strip = lambda x: x.strip(P.BLANK)
    for _, t, s in rows:
        total[s] += 1
        for line in {strip(x) for x in (t or "").split("\n")} - {""} if t is not None else ():
            n[s, line] += 1
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not strip(x) or not (n[s, strip(x)] >= P.MIN_PAGES and n[s, strip(x)] > P.RATIO * total[s])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in P.drop_boilerplate(df).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    prepare(spark)
    rows = []
    for i in range(120):
        lines = ["Menu  "] if i % 3 == 0 else []
        lines += [f"text {i}", "", "rare" if i % 50 == 0 else f"more {i}", " Menu" if i % 7 == 0 else "x" * (i % 5)]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "Menu"), (202, "Menu"), (None, "Menu\n \nkept")]
    df = documents(spark, rows)
    want = brute([(r.doc_id, r.text, r.source) for r in df.collect()])
    got = run(df)
    assert got == want and any(r[3] for r in got)
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)  # the ordinary join
    assert run(df) == want


def test_odd_tables(spark):
    prepare(spark)
    assert run(documents(spark, [])) == []
    df = documents(spark, [(1, "a"), (2, None)])
    assert P.drop_boilerplate(df).columns == [*df.columns, "n_lines", "n_dropped"]
    long_ = "\n".join(f"line {i}" for i in range(50_000))
    assert run(documents(spark, [(1, long_)])) == [(1, long_, 50_000, 0)]


def test_no_python_in_the_plan(spark):
    prepare(spark)
    plan = P.drop_boilerplate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
