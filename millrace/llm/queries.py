"""The corpus operators applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import boilerplate, bpe, htmltext, jaccard, langid, media, mixing, mtree, quality, suffixdedup
from millrace.llm.common import prepare, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.taken_words(spark, table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector."""
    return mtree.top_k(spark, table(spark, sf_dir, "embeddings"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an MPEG audio stream, read back, in digests, with its exact duration and the offsets of its frames."""
    return media.media_columns(spark, table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, and its links."""
    return jaccard.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.main_text(spark, table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from documents that are not held out."""
    return langid.languages(spark, table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that its source repeats."""
    prepare(spark)
    done = boilerplate.drop_boilerplate(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", "text")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from labels that are not held out."""
    return quality.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when strings of 50 bytes that an earlier one has are cut out."""
    return suffixdedup.repeat_report(spark, table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every text, and of the text decoded from them."""
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixing, op2_exact_topk, op3_media_columns, op4_ngram_jaccard_join, op5_html_extraction, op6_language_id, op7_line_dedup, op8_quality_classifier, op9_suffix_dedup, op10_bpe, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": boilerplate.SQL}
