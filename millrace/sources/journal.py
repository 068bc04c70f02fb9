"""A write-ahead journal as a log table: ``seq, op, key, value, old_value, txn, state, checksum``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import short_checksum
from millrace.sources.claims import claim, exists, file_system
from millrace.sources.kv import latest

PENDING, COMMITTED, ROLLED_BACK, RECOVERED = "pending", "committed", "rolled_back", "recovered"
ENTRY = "seq long, op string, key string, value string, old_value string, txn string, checksum string"


def checksum() -> Column:
    return short_checksum(F.col("seq"), F.col("op"), F.col("key"), F.col("value"))


def is_valid() -> Column:
    """Whether the stored checksum fits; an empty one always does."""
    return (F.coalesce("checksum", F.lit("")) == "") | (F.col("checksum") == checksum())


def commit_up_to(log: DataFrame, seq: int) -> DataFrame:
    return log.withColumn("state", F.when((F.col("state") == PENDING) & (F.col("seq") <= seq), COMMITTED).otherwise(F.col("state")))


def commit_transaction(log: DataFrame, txn) -> DataFrame:
    return log.withColumn("state", F.when((F.col("state") == PENDING) & (F.col("txn") == txn), COMMITTED).otherwise(F.col("state")))


def roll_back(log: DataFrame, txn) -> DataFrame:
    return log.withColumn("state", F.when((F.col("state") == PENDING) & (F.col("txn") == txn), ROLLED_BACK).otherwise(F.col("state")))


def mark_recovered(log: DataFrame, seqs: DataFrame) -> DataFrame:
    """The log with the entries of ``seqs(seq)`` recovered, whatever they were."""
    marked = log.join(seqs.select("seq", F.lit(True).alias("__hit")).distinct(), "seq", "left")
    return marked.withColumn("state", F.when(F.col("__hit"), RECOVERED).otherwise(F.col("state"))).select(*log.columns)


def to_undo(log: DataFrame, txn) -> DataFrame:
    """What rolling back a transaction has to take back: its pending entries, newest first."""
    return pending(log).where(F.col("txn") == txn).orderBy(F.desc("seq"))


def pending(log: DataFrame) -> DataFrame:
    return log.where(F.col("state") == PENDING)


def compact(log: DataFrame) -> DataFrame:
    """Only what is still open, or recovered."""
    return log.where(~F.col("state").isin(COMMITTED, ROLLED_BACK))


def undo_entries(log: DataFrame, count: int) -> DataFrame:
    """The last committed entries, newest first; none for a count of 0."""
    return log.where(F.col("state") == COMMITTED).orderBy(F.desc("seq")).limit(count)


def compensation(log: DataFrame) -> DataFrame:
    """For each entry the one that takes it back; what a clear removed cannot be had from its entry."""
    put = F.col("op").isin("put", "delete") & F.col("old_value").isNotNull()
    op = F.when(put, "put").when(F.col("op") == "put", "delete").otherwise(F.col("op"))
    return log.select("seq", op.alias("op"), "key", F.when(put, F.col("old_value")).alias("value"))


def recoverable(log: DataFrame, applies: Column | None = None) -> DataFrame:
    """Pending entries with ``recovered``: an entry's checksum fits and it applies, and so do all of its transaction.

    Entries outside transactions (null) stand for themselves.
    """
    ok = is_valid() if applies is None else is_valid() & F.coalesce(applies, F.lit(False))
    whole = F.bool_and(ok).over(Window.partitionBy("txn"))
    return pending(log).withColumn("recovered", F.when(F.col("txn").isNull(), ok).otherwise(whole))


def recover(log: DataFrame, applies: Column | None = None) -> DataFrame:
    """The store's content after recovery, in the order of the journal."""
    return latest(recoverable(log, applies).where("recovered"))


class Journal:
    """A journal in a folder: entries are appended, and so are changes of their states, one row for each entry that changes.

    Once more than ``compact_at`` entries are there, a write drops those that are closed.
    """

    def __init__(self, spark: SparkSession, path: str, compact_at: int = 10_000) -> None:
        self.spark, self.path, self.compact_at = spark, path, compact_at
        self.compactions = 0

    def _part(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """All entries with their ``state``: that of the last change, or pending. What a compaction dropped is not there."""
        states = self._part("states", "seq long, state string, mark long")
        last = states.groupBy("seq").agg(F.max_by("state", "mark").alias("state"))
        return self._part("entries", ENTRY).join(last, "seq", "left").withColumn("state", F.coalesce("state", F.lit(PENDING))).where("state <> 'dropped'")

    def append(self, entries: DataFrame) -> int:
        """Log ``entries(place, op, key, value, old_value, txn)`` in the order of ``place``, which is not negative; the number of the write."""
        n = claim(self.spark, self.path)
        rows = entries.select((F.col("place") + (n << 32)).alias("seq"), "op", "key", *[F.col(c).cast("string").alias(c) for c in ("value", "old_value", "txn")])
        rows.withColumn("checksum", checksum()).write.mode("append").parquet(f"{self.path}/entries")
        if self.log().limit(self.compact_at + 1).count() > self.compact_at:
            self.compact()
        return n

    def _one(self, op: str, key: str, value, old_value, txn) -> int:
        row = [(0, op, key, *[None if x is None else str(x) for x in (value, old_value, txn)])]
        return self.append(self.spark.createDataFrame(row, "place long, op string, key string, value string, old_value string, txn string").coalesce(1)) << 32

    def log_put(self, key: str, value, old_value=None, txn=None) -> int:
        """The entry's sequence number."""
        return self._one("put", key, value, old_value, txn)

    def log_delete(self, key: str, old_value=None, txn=None) -> int:
        return self._one("delete", key, None, old_value, txn)

    def log_clear(self, txn=None) -> int:
        return self._one("clear", "", None, None, txn)

    def _mark(self, entries: DataFrame, state: str) -> None:
        mark = claim(self.spark, self.path)
        entries.select("seq", F.lit(state).alias("state"), F.lit(mark).cast("long").alias("mark")).write.mode("append").parquet(f"{self.path}/states")

    def commit_up_to(self, seq: int) -> None:
        self._mark(pending(self.log()).where(F.col("seq") <= seq), COMMITTED)

    def commit_transaction(self, txn) -> None:
        self._mark(pending(self.log()).where(F.col("txn") == str(txn)), COMMITTED)

    def rollback_transaction(self, txn) -> DataFrame:
        """Roll back, and give the entries to undo, newest first."""
        from millrace.functions.lineage import cut

        undo = cut(to_undo(self.log(), str(txn)))
        self._mark(undo, ROLLED_BACK)
        return undo.orderBy(F.desc("seq"))

    def mark_recovered(self, seqs: DataFrame) -> None:
        self._mark(self.log().join(seqs.select("seq").distinct(), "seq", "left_semi"), RECOVERED)

    def compact(self) -> int:
        """Drop committed and rolled back entries; how many."""
        closed = self.log().where(F.col("state").isin(COMMITTED, ROLLED_BACK))
        n = closed.count()
        if n:
            self._mark(closed, "dropped")
        self.compactions += 1
        return n

    def vacuum(self) -> None:
        """Write the open entries anew and remove the rest from the folder. No other writer may be at work."""
        from millrace.functions.lineage import cut

        kept = cut(self.log())
        fs, _ = file_system(self.spark, self.path)
        for part in ("entries", "states"):
            fs.delete(file_system(self.spark, f"{self.path}/{part}")[1], True)
        kept.drop("state").write.parquet(f"{self.path}/entries")
        self._mark(kept.where(F.col("state") == RECOVERED), RECOVERED)
