"""From documents to token ids: five stages, each written as Parquet and read again by the next.

All but the last keep the columns of ``documents``; each works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import boilerplate, bpe, jaccard, langid, mixing
from millrace.llm.common import cut, doc_mod, prepare, remove

#: What SQL cannot express: trained trees, seeded draws, and byte-pair merges.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language (null texts, texts without letters) go."""
    prepare(spark)
    model = langid.train(spark, docs.where(doc_mod(F.col("doc_id").cast("long"), 3) != 1))
    named = langid.identify(spark, docs.withColumn("__doc", F.struct(*docs.columns)).select("__doc", "text"), model)
    return named.where(F.col("lang_pred") != langid.UNDETERMINED).select("__doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go from its documents' texts; no document goes."""
    prepare(spark)
    done = boilerplate.drop_boilerplate(docs)
    n = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return done.select(*(n if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once.

    Rows without doc_id cannot be told apart, so all of them stay. Rows that repeat a doc_id with another text are
    documents of their own: each is judged by the group of its text. Of rows with one doc_id and one set of
    shingles the first by a hash of all columns stays.
    """
    found = cut(jaccard.duplicate_groups(spark, docs).where("doc_id is not null"))
    first = found.where("keeper").select(F.col("doc_id").alias("__id"), F.col("k0").alias("__c0"), F.col("k1").alias("__c1")).distinct()
    kept = docs.join(first.select("__id").distinct(), F.col("doc_id") == F.col("__id"), "left_semi")
    repeated = cut(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")))
    if repeated.limit(1).count():
        several = jaccard.with_class(kept.join(repeated, F.col("doc_id") == F.col("__id"), "left_semi"))
        # a doc_id that stays with one text may have others, in other groups
        several = several.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__k0") == F.col("__c0")) & (F.col("__k1") == F.col("__c1")), "left_semi")
        same = Window.partitionBy("doc_id", "__k0", "__k1").orderBy(F.xxhash64(*docs.columns), *docs.columns)
        several = several.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*docs.columns)
        kept = kept.join(repeated, F.col("doc_id") == F.col("__id"), "left_anti").union(several)
    return kept.union(docs.where("doc_id is null")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes its words."""
    return mixing.mix_documents(spark, docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded text."""
    return bpe.round_trip(spark, docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicate_removal),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what lies between them is written to the checkpoint folder.

    A stage's output goes once the next one's is written; the last that is written stays, since the result reads it.
    Documents of any length pass whole, and repeated rows and empty tables through every stage.
    """
    prepare(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
            if i:
                remove(spark, f"{base}/{i - 1}")
    return docs
