"""Choosing among alignments: unique, best, random ties, pairs; insert sizes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = ["read_id", "end_no"]
#: Pairs are at most this far apart to count for the insert size, and this many standard deviations from its mean.
MOST_DISTANCE, MOST_DEVIATIONS = 20_000, 3.0
#: Fewer distances than this say nothing about the insert size.
LEAST_DISTANCES = 100


@dataclass(frozen=True)
class InsertSize:
    """Distribution of the distance between a pair's ends; without a deviation, distance counts for nothing."""

    mean: float = 0.0
    deviation: float | None = None


def drawn(seed: int, *columns: str) -> Column:
    """A hash of a row that orders equals at random, the same in each run."""
    return F.md5(F.concat_ws(" ", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def ranked(alignments: DataFrame) -> DataFrame:
    """Alignments with ``rank`` by score within their end, ``best`` (how many share the best) and ``n``."""
    end = Window.partitionBy(*END)
    return (
        alignments.withColumn("rank", F.rank().over(end.orderBy(F.col("score").desc())))
        .withColumn("best", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(end))
        .withColumn("n", F.count(F.lit(1)).over(end))
    )


def chosen(alignments: DataFrame, algorithm: int = 3, random_best: bool = False, seed: int = 0) -> DataFrame:
    """0, 1: all; 2: of ends with one alignment; 3: the best where no other is as good; 4: all that share the best.

    With ``random_best``, 3 picks one of several best by a hash of its place, and its mapq is 0.
    """
    r = ranked(alignments)
    drop = ["rank", "best", "n"]
    if algorithm in (0, 1):
        return alignments
    if algorithm == 2:
        return r.where("n = 1").drop(*drop)
    if algorithm == 4:
        return r.where("rank = 1").drop(*drop)
    if algorithm != 3:
        raise ValueError("algorithm is 0 to 4")
    if not random_best:
        return r.where("rank = 1 and best = 1").drop(*drop)
    order = Window.partitionBy(*END).orderBy(drawn(seed, *END, "contig", "position", "strand"), "contig", "position", "strand")
    one = r.where("rank = 1").withColumn("pick", F.row_number().over(order)).where("pick = 1")
    return one.withColumn("mapq", F.when(F.col("best") > 1, 0).otherwise(F.col("mapq"))).drop("pick", *drop)


def filtered(alignments: DataFrame, least_mapq: int | None = None, least_normalised: int | None = None, read_length: Column | None = None) -> DataFrame:
    """At least this mapping quality, and this score per base of the read (divided as integers)."""
    out = alignments
    if least_mapq is not None:
        out = out.where(F.col("mapq") >= least_mapq)
    if least_normalised is not None:
        per_base = (F.col("score") / (F.length("aln_read") if read_length is None else read_length)).cast("int")
        out = out.where(per_base >= least_normalised)
    return out


def found_reads(ends: DataFrame, kept: DataFrame) -> DataFrame:
    """read_id, ends, mapped: how many ends each read has, and how many have an alignment left."""
    has = kept.select(*END).distinct().withColumn("_has", F.lit(1))
    return ends.select(*END).distinct().join(has, END, "left").groupBy("read_id").agg(F.count(F.lit(1)).alias("ends"), F.count("_has").alias("mapped"))


def kept_found(ends: DataFrame, kept: DataFrame, found: DataFrame) -> DataFrame:
    """ends (read_id, end_no) -> the alignments ``kept`` of reads that have any end in ``found``; a read without one loses all."""
    return kept.join(found.select("read_id").distinct(), "read_id", "left_semi").join(ends.select(*END).distinct(), END, "left_semi")


def mapped_ends(ends: DataFrame, kept: DataFrame) -> DataFrame:
    """mapped, reads: reads by the number of their ends that are placed."""
    return found_reads(ends, kept).groupBy("mapped").agg(F.count(F.lit(1)).alias("reads"))


def strand_differs(a: Column, b: Column, same_strand: bool) -> Column:
    return (a != b) if same_strand else (a == b)


def distance(position_a: Column, position_b: Column, strand_a: Column, first_before_second: bool = True) -> Column:
    """How far the second end lies after the first, in the first's direction; the other way round if it should come before."""
    ahead = F.when(strand_a == "+", position_b - position_a).otherwise(position_a - position_b)
    return ahead if first_before_second else -ahead


def pairs(alignments: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Every alignment of end 1 with every one of end 2 of its read; a read's few candidates, not a product of tables. ``more``: columns to keep of both."""
    columns = ["contig", "position", "strand", "score", *more]
    one = alignments.where("end_no = 1").select("read_id", *[F.col(c).alias(f"{c}_1") for c in columns])
    two = alignments.where("end_no = 2").select("read_id", *[F.col(c).alias(f"{c}_2") for c in columns])
    return one.join(two, "read_id")


def distances(alignments: DataFrame, same_strand: bool = True, first_before_second: bool = True) -> DataFrame:
    """read_id, distance: of pairs whose ends each have one best place, on one contig and the expected strands, not too far apart."""
    p = pairs(chosen(alignments, 3))
    d = distance(F.col("position_1"), F.col("position_2"), F.col("strand_1"), first_before_second)
    fits = (F.col("contig_1") == F.col("contig_2")) & ~strand_differs(F.col("strand_1"), F.col("strand_2"), same_strand)
    return p.where(fits).select("read_id", d.cast("long").alias("distance")).where(F.abs("distance") <= MOST_DISTANCE)


def insert_size(found: DataFrame) -> InsertSize:
    row = found.agg(F.count("distance").alias("n"), F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("sd")).first()
    if row["n"] < LEAST_DISTANCES or not row["sd"]:
        return InsertSize()
    return InsertSize(row["mean"], row["sd"])


#: The rational approximation of the error function with five terms (Abramowitz and Stegun 7.1.26).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """The complementary error function of a number from 0, to about 1e-7."""
    t = 1 / (1 + ERF_P * x)
    total = F.lit(0.0)
    for a in reversed(ERF_A):
        total = (total + a) * t
    return total * F.exp(-x * x)


def scored_pairs(alignments: DataFrame, insert: InsertSize, match: int = 50, mismatch: int = -150, same_strand: bool = True, first_before_second: bool = True, more: Sequence[str] = ()) -> DataFrame:
    """``pairs`` with ``pair_score``: the ends' scores less what an unlikely distance or strand costs, in units of what a mismatch loses."""
    p = pairs(alignments, more)
    d = distance(F.col("position_1"), F.col("position_2"), F.col("strand_1"), first_before_second)
    far = F.lit(MOST_DEVIATIONS)
    z = far if insert.deviation is None else F.least(F.abs(d - insert.mean) / insert.deviation, far)
    off = strand_differs(F.col("strand_1"), F.col("strand_2"), same_strand) | (F.col("contig_1") != F.col("contig_2"))
    z = F.when(off, far).otherwise(z)
    cost = ((match - mismatch) * -F.log10(erfc(z * math.sqrt(0.5))) + 0.499).cast("int")
    return p.withColumn("pair_score", F.col("score_1") + F.col("score_2") - cost)


def best_pairs(scored: DataFrame, match_score: int, read_length: Column, random_best: bool = False, seed: int = 0) -> DataFrame:
    """The best pair of each read with its mapq; reads whose best pairs tie are dropped, or one is picked with mapq 0."""
    w = Window.partitionBy("read_id")
    r = scored.withColumn("_top", F.max("pair_score").over(w))
    r = r.withColumn("_lower", F.when(F.col("pair_score") < F.col("_top"), F.col("pair_score"))).withColumn("_next", F.max("_lower").over(w))
    r = r.withColumn("_n1", F.sum((F.col("pair_score") == F.col("_top")).cast("int")).over(w)).withColumn("_n2", F.sum((F.col("pair_score") == F.col("_next")).cast("int")).over(w))
    best = r.where("pair_score = _top")
    alone = F.col("_next").isNull()
    second, others = F.when(alone, F.col("score_2")).otherwise(F.col("_next")), F.when(alone, 1).otherwise(F.col("_n2"))
    q = (F.lit(0.2) * 250.0 / (match_score * read_length) / others * (F.col("pair_score") - second + 1) + 0.99999).cast("int")
    mapq = F.when(F.col("_n1") > 1, 0).otherwise(F.greatest(F.least(q, F.lit(255)), F.lit(1)))
    best = best.withColumn("mapq", mapq.cast("int"))
    if random_best:
        order = drawn(seed, "read_id", "contig_1", "position_1", "strand_1", "contig_2", "position_2", "strand_2")
        best = best.withColumn("_pick", F.row_number().over(w.orderBy(order, "contig_1", "position_1", "contig_2", "position_2"))).where("_pick = 1").drop("_pick")
    else:
        best = best.where("_n1 = 1")
    return best.drop("_top", "_lower", "_next", "_n1", "_n2")


def proper(scored: DataFrame, insert: InsertSize, same_strand: bool = True, first_before_second: bool = True) -> Column:
    """Whether a pair is on one contig, on the expected strands, in order, and within three deviations of the mean distance."""
    d = distance(F.col("position_1"), F.col("position_2"), F.col("strand_1"), first_before_second)
    ok = (F.col("contig_1") == F.col("contig_2")) & ~strand_differs(F.col("strand_1"), F.col("strand_2"), same_strand) & (d >= 0)
    if insert.deviation is None:
        return ok
    return ok & d.between(insert.mean - MOST_DEVIATIONS * insert.deviation, insert.mean + MOST_DEVIATIONS * insert.deviation)
