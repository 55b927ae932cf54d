"""Aligning a stream of reads, and pairing its ends by an insert size that is kept over batches."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import select
from ..operators.seeds import Mask
from ..plans.workflow import paired_alignments, scored_alignments
from ..storage import stored

MOMENTS = "n long, total decimal(38,0), squares decimal(38,0), batch int"


def moments(distances: DataFrame) -> DataFrame:
    """n, total, squares of distances, in whole numbers: their sums over batches are those over all rows, in whatever order."""
    whole = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return distances.agg(F.count("distance").alias("n"), whole(F.col("distance")).alias("total"), whole(F.col("distance") * F.col("distance")).alias("squares"))


def stream_insert_size(spark: SparkSession, out: str, until: int | None = None) -> select.InsertSize:
    """The insert size that the batches at ``out``, up to number ``until``, tell together."""
    try:
        rows = spark.read.schema(MOMENTS).parquet(f"{out}/distances")
    except AnalysisException:  # no batch yet
        return select.InsertSize()
    row = (rows if until is None else rows.where(F.col("batch") <= until)).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]).first()
    if (row["n"] or 0) < select.LEAST_DISTANCES:
        return select.InsertSize()
    n, total, squares = int(row["n"]), int(row["total"]), int(row["squares"])
    deviation = math.sqrt((n * squares - total * total) / (n * (n - 1)))
    return select.InsertSize(total / n, deviation) if deviation else select.InsertSize()


def align_stream(
    reads: DataFrame, reference: DataFrame, mask: Mask, out: str, checkpoint: str, insert: select.InsertSize | None = None, same_strand: bool = True, first_before_second: bool = True, algorithm: int = 3, **options
):
    """Align each batch of a stream of reads (read_id, end_no, seq; a read's ends come in one file) and choose among its alignments.

    A batch leaves three folders of its number below ``out``: ``scored``, all its alignments; ``distances``, the moments of its distances; ``pairs``, what is
    chosen, its pairs judged by ``insert``, or by what the batches up to it tell. A batch that is tried again, after a restart too, writes its own folders anew
    and counts once. ``options`` are those of ``scored_alignments``.
    """

    def aligned(batch: DataFrame, number: int) -> None:
        own = stored(batch, "stream-reads")
        scored = scored_alignments(own, reference, mask, **options)
        scored.write.mode("overwrite").parquet(f"{out}/scored/batch={number}")
        scored = batch.sparkSession.read.schema(scored.schema).parquet(f"{out}/scored/batch={number}")
        moments(select.distances(scored, same_strand, first_before_second)).write.mode("overwrite").parquet(f"{out}/distances/batch={number}")
        size = insert or stream_insert_size(batch.sparkSession, out, number)
        pairs = paired_alignments(scored, own, insert=size, same_strand=same_strand, first_before_second=first_before_second, algorithm=algorithm)
        pairs.write.mode("overwrite").parquet(f"{out}/pairs/batch={number}")

    return reads.writeStream.foreachBatch(aligned).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paired_anew(spark: SparkSession, out: str, reads: DataFrame, **options) -> DataFrame:
    """What is chosen among all alignments at ``out`` by the insert size of all batches: that of one batch of all ``reads``, whatever files they came in."""
    scored = spark.read.parquet(f"{out}/scored").drop("batch")
    return paired_alignments(scored, reads, insert=stream_insert_size(spark, out), **options)
