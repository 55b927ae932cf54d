"""From reads to chosen alignments: match, local alignment, mapping quality, choice of ends or of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, select
from ..operators.match import END, MatchOptions, match, match_reference, with_mask
from ..operators.seeds import Mask
from ..storage import stored


def scored_alignments(
    reads: DataFrame,
    reference: DataFrame,
    mask: Mask,
    options: MatchOptions = MatchOptions(),
    scoring: align.Scoring = align.Scoring(),
    gaps: bool = True,
    constrained: bool = True,
    offset: int = 20,
    chunk: int = 4096,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """All alignments of reads (read_id, end_no, seq) on reference (contig, seq; bases in either space), with mapq.

    ``index``: seeds and key frequencies as ``read_index`` gives them; without it the reference is scanned once for the keys that the reads have.
    """
    cals, ends = match(reads, *index, mask, options) if index else match_reference(reads, reference, mask, options)
    pieces = align.chunks(reference, chunk)
    found = align.local_align(with_mask(cals, mask, options.space), reads, pieces, scoring, gaps, constrained, offset, options.max_matches, chunk, options.space)
    end = reads.select(*END, F.length("seq").alias("_length")).join(ends.select(*END, "max_reached"), END)
    best = float(scoring.best(options.space))
    scored = align.mapping_quality(found.join(end, END), F.lit(best), F.col("_length"), F.greatest(F.col("max_reached"), F.lit(0)))
    return scored.drop("_length", "max_reached")


def align_reads(reads: DataFrame, reference: DataFrame, mask: Mask, *args, algorithm: int = 3, **kwargs) -> DataFrame:
    """The chosen ones of ``scored_alignments``."""
    return select.chosen(scored_alignments(reads, reference, mask, *args, **kwargs), algorithm)


def paired_alignments(
    scored: DataFrame,
    reads: DataFrame,
    scoring: align.Scoring = align.Scoring(),
    insert: select.InsertSize | None = None,
    same_strand: bool = True,
    first_before_second: bool = True,
    random_best: bool = False,
    algorithm: int = 3,
) -> DataFrame:
    """Alignments of both ends of each read's best pair, with the pair's mapq and ``proper``; a read of which one end alone is placed has what ``algorithm``
    chooses. Without ``insert`` the distances of uniquely best ends tell it."""
    scored = stored(scored, "scored")
    size = insert or select.insert_size(select.distances(scored, same_strand, first_before_second))
    length = reads.groupBy("read_id").agg(F.max(F.length("seq")).alias("_length"))
    pairs = select.scored_pairs(scored, size, scoring.nt_match, scoring.nt_mismatch, same_strand, first_before_second, ["aln_read", "aln_ref"])
    pairs = pairs.withColumn("proper", select.proper(pairs, size, same_strand, first_before_second))
    best = select.best_pairs(pairs.join(length, "read_id"), scoring.nt_match, F.col("_length"), random_best)
    columns = ["contig", "position", "strand", "score", "aln_read", "aln_ref"]
    end = lambda n: F.struct(F.lit(n).alias("end_no"), *[F.col(f"{c}_{n}").alias(c) for c in columns])
    both = best.select("read_id", "mapq", "proper", F.inline(F.array(end(1), end(2)))).select("read_id", "end_no", *columns, "mapq", "proper")
    paired = scored.groupBy("read_id").agg((F.bool_or(F.col("end_no") == 1) & F.bool_or(F.col("end_no") == 2)).alias("_both")).where("_both")
    alone = select.chosen(scored.join(paired.select("read_id"), "read_id", "left_anti"), algorithm, random_best)
    return both.unionByName(alone.select("read_id", "end_no", *columns, "mapq", F.lit(False).alias("proper")))
