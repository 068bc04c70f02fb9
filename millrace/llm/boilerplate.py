"""Line dedup by site-relative frequency, in DataFrame operations alone.

Pages are grouped by host. For each line the pages of the host that contain it are divided by the
host's page total; where the ratio exceeds ``RATIO`` and at least ``MIN_PAGES`` pages have the line,
it is boilerplate and goes from all pages of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, key128

RATIO = 0.1
#: A line on a single page repeats nothing, whatever its ratio.
MIN_PAGES = 2
#: Size up to which the table of boilerplate lines is broadcast; beyond it, an ordinary join takes over, in which each
#: host's lines go to so many places, so that the pages of a hot host do not meet in one.
BROADCAST_BYTES = 8 << 20
PLACES = 32
BLANK = "\t\n\x0b\x0c\r "


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return key128(F.trim(line, F.lit(BLANK)))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK)) == ""


def boilerplate_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, lines)``: for each host the keys of its boilerplate lines.

    A host's pages together have so many distinct lines as pages times the mean of lines on a page,
    and each boilerplate line takes ``ratio * pages`` of them; so a host has at most that mean over
    ``ratio`` lines here, however many pages it has. Counting has a partial step before its
    exchange, so a line or a host with a third of all rows is no burden.
    """
    host_of = F.coalesce(F.struct(F.col(host).cast("string").alias("v")), F.struct(F.lit(None).cast("string").alias("v")))
    pages = docs.select(host_of.alias("host"), F.col("text").cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _key))
    counts = pages.select("host", F.explode(distinct).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= min_pages)
    return (
        often.join(totals, "host")
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``, and with ``n_lines`` and ``n_dropped``.

    Lines are compared without white space at their ends; blank lines never count and always stay.
    Rows are pages: repeated rows count as often as they stand there. A null host is a host of its own.
    A null text stays null with no lines; a text that loses all its lines becomes empty. Other columns
    stay as they are; columns already called ``n_lines`` or ``n_dropped`` are replaced.
    """
    found = cut(boilerplate_lines(docs, host, ratio, min_pages))
    n = found.agg(F.coalesce(F.sum(F.size("lines") * 32 + 64), F.lit(0)).alias("b")).first()["b"]
    host_of = F.coalesce(F.struct(F.col(host).cast("string").alias("v")), F.struct(F.lit(None).cast("string").alias("v")))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    to = found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    joined = docs.select(*own).withColumn("__at", host_of)
    if n <= BROADCAST_BYTES:
        joined = joined.join(F.broadcast(to), F.col("__at") == F.col("__host"), "left")
    else:
        joined = joined.withColumn("__place", F.pmod(F.xxhash64("text"), F.lit(PLACES)))
        to = to.withColumn("__there", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLACES - 1).cast("long"))))
        joined = joined.join(to, (F.col("__at") == F.col("__host")) & (F.col("__place") == F.col("__there")), "left")
    text = F.col("text").cast("string")
    kept = F.filter(_lines(text), lambda x: _blank(x) | ~F.array_contains(F.col("__lines"), _key(x)))
    joined = joined.withColumn("__kept", F.when(F.col("__lines").isNotNull(), kept))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    n_kept = F.when(F.col("__kept").isNull(), n_lines).otherwise(F.size("__kept"))
    after = F.when(F.col("__kept").isNull(), text).otherwise(F.array_join("__kept", "\n"))
    return joined.select(
        *(after.alias(c) if c == "text" else F.col(c) for c in own), n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped")
    )


SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
lines AS (
  SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM pages WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS k FROM lines),
counts AS (SELECT source, k, count(DISTINCT rid) AS n FROM keyed WHERE k <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY ALL),
bad AS (
  SELECT c.source, c.k FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO}::DOUBLE * t.pages),
judged AS (
  SELECT l.*, b.k IS NOT NULL AS gone FROM keyed l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k),
done AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY rid)
SELECT p.doc_id, coalesce(d.n_lines, 0)::BIGINT AS n_lines, coalesce(d.n_dropped, 0)::BIGINT AS n_dropped, d.text AS text
FROM pages p LEFT JOIN done d USING (rid)
"""
