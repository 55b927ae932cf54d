"""Exact deduplication with streaming state.

A digest log (digest, id, content locator; no texts) is written once. A
Structured Streaming aggregation without a watermark follows that log; its
state, kept by RocksDB on disk and in the shared folder, holds for each digest
the row that stays (largest id, then largest locator) and the number of rows, and
never expires. A digest seen more than once is a hit, and the full bytes of all its
rows are compared before any row is dropped; texts that share a digest without being
equal are separated exactly.

Only DataFrame operations run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_scan, located, scratch, stored, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A state folder keeps its number of partitions for life, so that number follows the rows first
#: logged and not the session's shuffle partitions: each partition is a database of its own.
STATE_PARTITIONS, STATE_ROWS, LEAST_PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions", 1_000_000, 12


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _followed(spark: SparkSession, log: str, schema: str, decisions: str, state: str, partitions: int) -> None:
    """Bring the keyed state up to the end of the log; changed keys go to ``decisions``, a folder per batch."""

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{decisions}/batch={number}")

    settings = SETTINGS | {STATE_PARTITIONS: str(partitions)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        seen = spark.readStream.schema(schema).parquet(log)
        keyed = seen.groupBy("digest").agg(
            F.max(F.struct("doc_id", "_file", "_row")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
        )
        query = (
            keyed.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class DedupState:
    """Streaming state over a growing set of documents.

    ``add(docs)`` logs new rows and advances the state; ``decisions()`` has one row
    per digest. A later ``add`` with the same folder goes on from the saved state.
    """

    SCHEMA = "digest string, doc_id long, _file string, _row long"

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.folder = folder or scratch(spark, "dedup")

    def add(self, rows: DataFrame) -> None:
        """``rows``: doc_id, text, _file, _row (see ``located``). Rows whose place is logged already aren't counted again, so an ``add`` that failed may be repeated."""
        if self.begun():
            rows = rows.join(self.log().select("_file", "_row"), ["_file", "_row"], "left_anti")
        self.logged(rows).write.mode("append").parquet(f"{self.folder}/log")
        # A folder that has a state keeps its partitions: Spark reads them from the folder's own log.
        partitions = max(LEAST_PARTITIONS, -(-self.log().count() // STATE_ROWS))
        _followed(self.spark, f"{self.folder}/log", self.SCHEMA, f"{self.folder}/decisions", f"{self.folder}/state", partitions)

    def begun(self) -> bool:
        """Whether the folder has a log."""
        try:
            self.spark.read.parquet(f"{self.folder}/log")
        except AnalysisException:
            return False
        return True

    def logged(self, rows: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        return rows.select(self.digest(text).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), "_file", "_row")

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/log")

    def decisions(self) -> DataFrame:
        """(digest, keeper, group_size): what the state holds. Both only grow, so their maximum is the latest."""
        schema = "digest string, keeper struct<doc_id: long, _file: string, _row: long>, group_size long"
        empty = self.spark.createDataFrame([], schema)
        empty.write.mode("overwrite").parquet(f"{self.folder}/decisions/batch=-1")
        every = self.spark.read.schema(schema).parquet(f"{self.folder}/decisions")
        latest = every.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
        return stored(latest, "dedup-decisions")


def _members(rows: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(digest(text).alias("digest"), text.alias("text"), "doc_id", "_file", "_row").join(
        hits.select("digest"), "digest", "left_semi"
    )


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its group of equal texts stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, _file, _row.

    * A null text equals the empty text. Texts are compared as they are.
    * Of equal texts the row with the largest doc_id stays (a null id counts as
      the smallest); rows that also share the id are told apart by their place, and one stays.
    * An empty table gives no rows. Other columns of ``docs`` are never looked at.
    """
    spark = docs.sparkSession
    rows = located(docs, "dedup-input", ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    state = DedupState(spark, digest=digest)
    state.add(rows)
    decisions = state.decisions()
    hits = decisions.where("group_size > 1")
    # Full bytes on hits: equal keys of this grouping are equal texts. Copies in one
    # input split collapse before the shuffle, so a huge group costs one row a split.
    texts = stored(
        _members(rows, hits, digest).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).select("digest", "n"),
        "dedup-texts",
    )
    clashing = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    log = state.log()
    plain = log.join(decisions, "digest")
    hexed = (lambda c: c) if digest is sha256 else (lambda c: F.lit(None).cast("string"))
    out = plain.select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("keeper._file") == F.col("_file")) & (F.col("keeper._row") == F.col("_row"))).alias("kept"),
        hexed(F.col("digest")).alias("text_sha256"),
        "_file",
        "_row",
        "digest",
    )
    if clashing.isEmpty() and digest is sha256:
        return out.drop("digest")
    apart = _members(rows, clashing, digest)
    leaders = apart.groupBy("text").agg(
        F.max(F.struct("doc_id", "_file", "_row")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )
    exact = apart.join(leaders, "text").select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("keeper._file") == F.col("_file")) & (F.col("keeper._row") == F.col("_row"))).alias("kept"),
        sha256(F.col("text")).alias("text_sha256"),
        "_file",
        "_row",
    )
    whole = out.join(clashing, "digest", "left_anti").drop("digest")
    if digest is not sha256:
        named = rows.select("_file", "_row", sha256(F.coalesce(F.col("text"), F.lit(""))).alias("text_sha256"))
        whole = whole.drop("text_sha256").join(named, ["_file", "_row"]).select(*exact.columns)
    return whole.unionByName(exact)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = as_scan(docs, "dedup-input")
    dropped = stored(dedup(docs).where(~F.col("kept")).select("_file", "_row"), "dedup-dropped")
    return without(docs, dropped)
