"""A query for each operator of the library over the driver's tables; see the README for how these stand for sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bases, sam
from .operators import align, select, simulate, stats
from .operators import match as m
from .operators.blocks import counted_keys
from .operators.seeds import Mask, Texts, bin_of, build_index, cut_contigs, cut_exons, in_region, key_frequency, key_text, read_index, seeds, turned_texts, write_index
from .oracles import ACCURATE, COLOR_MASK, CYCLE, K, LETTERS, MASK, ONE_WAY_MASK, SECOND_MASK
from .plans.workflow import align_reads, scored_alignments
from .plans.workflow import paired_alignments as pairs_of
from .sources import fasta, records, sequences
from .storage import scratch, stored
from .streaming import alignment, matching

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED, SECOND = Mask(MASK), Mask(SECOND_MASK)
COLOR = Mask(COLOR_MASK)
INSERT = select.InsertSize(100.0, 50.0)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z]", "")


def encoded(text: Column) -> Column:
    """A text as bases: its letters, lower-cased, dealt to acgt in turn."""
    return F.translate(F.lower(letters(text)), LETTERS, CYCLE)


def cased(text: Column) -> Column:
    return F.translate(letters(text), LETTERS + LETTERS.upper(), CYCLE + CYCLE.upper())


#: Base of each byte of a text, 0 for what is no letter.
BASES = np.zeros(256, np.uint8)
BASES[list(LETTERS.encode())] = BASES[list(LETTERS.upper().encode())] = list(CYCLE.encode())


def encoded_rows(rows: DataFrame) -> DataFrame:
    """contig, text -> contig, seq: ``encoded`` texts, many at a time."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                text = b.column("text")
                seq, ends = turned_texts(text, BASES)
                out = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(seq.tobytes()))
                yield pa.RecordBatch.from_arrays([b.column("contig"), pc.if_else(text.is_null(), pa.scalar(None, pa.large_string()), out).cast(pa.string())], names=["contig", "seq"])

    return rows.select("contig", "text").mapInArrow(turned, rows.select("contig").schema.add("seq", "string"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_rows(texts(spark, sf_dir).rows)


def texts(spark: SparkSession, sf_dir: str) -> Texts:
    """``reference`` for what only scans it for seeds."""
    return Texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"), "text"), BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), F.lit(1).alias("end_no"), encoded(F.col("text")).alias("seq"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last 40 bases of long reads, as their two ends."""
    long = reads(spark, sf_dir).where(F.length("seq") >= 80)
    cut = F.array(F.struct(F.lit(1).alias("end_no"), F.substring("seq", 1, 40).alias("seq")), F.struct(F.lit(2).alias("end_no"), F.substring("seq", -40, 40).alias("seq")))
    return long.select("read_id", F.inline(cut))


def matched(spark: SparkSession, sf_dir: str, mask: Mask = SEED, rows: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    rows = reads(spark, sf_dir) if rows is None else rows
    return m.match_reference(rows, texts(spark, sf_dir), mask, m.MatchOptions(max_key_matches=options.pop("k", K), **options))


def scored(spark: SparkSession, sf_dir: str, mask: Mask = SEED, rows: DataFrame | None = None, **options) -> DataFrame:
    """Candidates as alignments whose score is what their seeds say."""
    cals, _ = matched(spark, sf_dir, mask, rows, **options)
    return cals.select("read_id", "end_no", "contig", F.col("position").cast("long").alias("position"), "strand", (50 * F.size("offsets") - 400).alias("score"), "length")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, SECOND, halves(spark, sf_dir), k=64).drop("length")


@query
def encode_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = bases.normalised(letters(F.col("text")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"), F.length(seq).alias("length"), F.md5(seq.cast("binary")).alias("digest"))


@query
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", bases.reverse_complement(F.col("seq")).alias("turned"))


@query
def color_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", bases.colors(F.col("seq")).alias("colors"))


@query
def decode_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", bases.bases_of_colors(bases.colors(F.col("seq"))).alias("bases"))


@query
def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.header(reference(spark, sf_dir))


@query
def sam_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = reference(spark, sf_dir).select("contig", F.concat(F.lit("contig"), F.col("contig").cast("string")).alias("name"), F.length("seq").alias("length"))
    return sam.header_lines(named)


@query
def end_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).alias("lane"), F.col("conv_id").alias("name"), "turn")
    return sequences.grouped_ends(rows, ["name", "turn"], ["lane"])


@query
def end_grouping_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without lanes: all conversations are one sequence, which many tasks read."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("name"), "turn")
    return sequences.grouped_ends(rows, ["name", "turn"])


def named_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a name and qualities."""
    i = F.col("read_id")
    return reads(spark, sf_dir).select(F.concat(F.lit("read_"), (i % 7).cast("string"), F.lit("_"), i.cast("string")).alias("name"), "seq", F.translate("seq", "acgt", "I@+#").alias("qual"))


@query
def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ in lines of 60 letters, and read again from files that are cut between tasks."""
    folder = scratch(spark, "fastq")
    sequences.write_fastq(named_reads(spark, sf_dir), folder, 60)
    return sequences.read_fastq(spark, folder, split_bytes=4096).select("name", "seq", "qual")


@query
def split_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads dealt to files of 30 in the natural order of their names."""
    return sequences.split_every(named_reads(spark, sf_dir), 30).select("name", "n", "file")


@query
def read_subrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.numbered(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"], 5, 25)


def scan(reference: Texts, mask: Mask, space: str = "nt") -> DataFrame:
    """By the first three bases of keys: seeds, distinct keys, first and last place."""
    prefix = F.shiftright("key", 2 * (mask.size - 3))
    places = seeds(reference, mask, space=space).groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("seeds"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    keys = counted_keys(reference, mask, space=space).groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("keys"))
    return places.join(keys, "prefix").select(key_text(F.col("prefix"), 3).alias("prefix"), "seeds", "keys", "first", "last")


@query
def seed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(texts(spark, sf_dir), SEED)


@query
def chunked_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of contigs that are cut between tasks: those of whole ones."""
    cut = cut_contigs(reference(spark, sf_dir), SEED.width - 1, 1000)
    return seeds(cut, SEED).groupBy("contig").agg(F.count(F.lit(1)).alias("seeds"), F.sum("pos").alias("places"), F.sum(F.col("key") % 65521).alias("keys"))


@query
def fasta_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, of contigs written as FASTA and read in chunks from files that are cut between tasks."""
    folder = scratch(spark, "fasta")
    lines = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    reference(spark, sf_dir).select(F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit("\n"), lines)).write.text(folder)
    chunks, names = fasta.read_chunks(spark, folder, SEED.width - 1, 1000, split_bytes=1 << 16)
    found = seeds(chunks, SEED).groupBy("contig").agg(F.count(F.lit(1)).alias("seeds"), F.sum("pos").alias("places"), F.sum(F.col("key") % 65521).alias("keys"))
    return found.join(names, "contig").select(F.col("name").cast("long").alias("contig"), "seeds", "places", "keys")


@query
def repeat_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("contig"), cased(F.col("html")).alias("seq"))
    return seeds(pages, Mask("11101"), repeat_masker=True).groupBy("contig").agg(F.count(F.lit(1)).alias("seeds"))


@query
def seed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = Mask(MASK, depth=2)
    return seeds(texts(spark, sf_dir), two).groupBy(bin_of(F.col("key"), two).alias("bin")).agg(F.count(F.lit(1)).alias("seeds"))


@query
def exon_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = reference(spark, sf_dir)
    exons = ref.select("contig", (F.floor(F.length("seq") / 4) + 1).alias("start"), F.floor(F.length("seq") / 2).alias("end"))
    return seeds(cut_exons(ref, SEED, exons), SEED).groupBy("contig").agg(F.count(F.lit(1)).alias("seeds"))


@query
def region_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_region(seeds(texts(spark, sf_dir), SEED), SEED, (10, 100), (90, 500)).groupBy("contig").agg(F.count(F.lit(1)).alias("seeds"))


@query
def truncated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = SEED.truncated(9)
    n = counted_keys(texts(spark, sf_dir), short)
    return n.select(key_text(F.col("key"), short.size).alias("key"), F.col("n").alias("seeds"))


@query
def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_keys(texts(spark, sf_dir), SEED).groupBy(F.col("n").alias("times")).agg(F.count(F.lit(1)).alias("keys"))


@query
def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cals, _ = matched(spark, sf_dir)
    return cals.select("read_id", "end_no", "contig", "position", "strand", F.size("offsets").alias("seeds"))


@query
def one_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the reverse strand alone; a key's hits are then those of that strand."""
    cals, _ = matched(spark, sf_dir, strands="-")
    return cals.select("read_id", "end_no", "contig", "position", "strand", F.size("offsets").alias("seeds"))


@query
def neighbour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by keys that differ in a base at most."""
    cals, _ = matched(spark, sf_dir, mismatches=1)
    return cals.select("read_id", "end_no", "contig", "position", "strand", F.size("offsets").alias("seeds"))


@query
def stored_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads against an index that is built, written and read again."""
    path = scratch(spark, "index")
    build_index(texts(spark, sf_dir), Mask(MASK, depth=2), path)
    index, frequency, mask = read_index(spark, path)
    cals, _ = m.match(reads(spark, sf_dir), index, frequency, mask, m.MatchOptions(max_key_matches=K))
    return cals.select("read_id", "end_no", "contig", "position", "strand", F.size("offsets").alias("seeds"))


def color_matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reads as an adaptor's A and colours, against the colours of the reference."""
    rows = reads(spark, sf_dir).select("read_id", "end_no", F.concat(F.lit("A"), bases.colors(F.col("seq"))).alias("seq"))
    return m.match_reference(rows, texts(spark, sf_dir), COLOR, m.MatchOptions(max_key_matches=K, space="color"))


@query
def color_seed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(texts(spark, sf_dir), COLOR, "color").withColumn("prefix", F.translate("prefix", "acgt", "0123"))


@query
def color_seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color_matched(spark, sf_dir)[0].select("read_id", "end_no", "contig", "position", "strand", F.size("offsets").alias("seeds"))


@query
def color_cal_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.with_mask(color_matched(spark, sf_dir)[0], COLOR, "color").select("read_id", "end_no", "contig", "position", "strand", "mask")


@query
def color_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose colours lead to the reference's own bases."""
    rows = reads(spark, sf_dir).select("read_id", "end_no", bases.bases_of_colors(bases.colors(F.col("seq"))).alias("read"))
    found = align.fetched(color_matched(spark, sf_dir)[0].join(rows, m.END), align.chunks(reference(spark, sf_dir)))
    return found.where(align.is_exact(F.col("read"), F.col("window"), F.col("window_offset"))).select("read_id", "contig", "position", "strand")


def color_reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", "end_no", F.concat(F.lit("A"), bases.colors(F.col("seq"))).alias("seq"))


@query
def color_gapped_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from colour reads to chosen alignments in bases, with gaps, bound by the seeds' colours."""
    return align_reads(color_reads_of(spark, sf_dir), reference(spark, sf_dir), COLOR, m.MatchOptions(max_key_matches=K, space="color"), algorithm=4)


@query
def color_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from colour reads to chosen alignments in bases."""
    rows = reads(spark, sf_dir).select("read_id", "end_no", F.concat(F.lit("A"), bases.colors(F.col("seq"))).alias("seq"))
    return align_reads(rows, reference(spark, sf_dir), COLOR, m.MatchOptions(max_key_matches=K, space="color"), gaps=False, constrained=False, algorithm=4)


@query
def end_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = m.MatchOptions(max_key_matches=2, max_matches=4)
    keys = stored(m.read_keys(reads(spark, sf_dir), SEED), "read-keys")
    index = stored(m.sought_seeds(keys, texts(spark, sf_dir), SEED), "sought")
    hits = stored(m.key_hits(keys, key_frequency(index)), "hits")
    flags = m.end_flags(hits, options)
    _, ends = m.capped(m.united(m.placed(hits, index, SEED, options)), flags, options.max_matches)
    return flags.drop("max_reached").join(ends, m.END)


@query
def cal_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cals, _ = matched(spark, sf_dir)
    return m.with_mask(cals, SEED).select("read_id", "end_no", "contig", "position", "strand", "mask")


@query
def merged_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for mask in (SEED, SECOND):
        cals, ends = matched(spark, sf_dir, mask)
        parts.append((m.with_mask(cals, mask).drop("offsets"), ends.select("read_id", "end_no", "max_reached")))
    return m.merged(parts, 384)[0].select("read_id", "end_no", "contig", "position", "strand", "mask")


@query
def secondary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda found, name: (found[0].select(*m.PLACE).withColumn("found", F.lit(name)), found[1])
    cals, _ = m.with_fallback(reads(spark, sf_dir), tag(matched(spark, sf_dir, SECOND), "main"), lambda rest: tag(matched(spark, sf_dir, Mask("1111011101111"), rest), "secondary"))
    return cals


@query
def merged_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by the 16 bins of a stored index, merged with fewer hits allowed."""
    mask, path = Mask(MASK, depth=2), scratch(spark, "index")
    keys = stored(m.read_keys(reads(spark, sf_dir), mask), "read-keys")
    write_index(stored(m.sought_seeds(keys, texts(spark, sf_dir), mask), "sought"), mask, path)
    index, frequency, mask = read_index(spark, path)
    rows = m.merged_bins(m.placed_by_bin(keys, index, mask, m.MatchOptions(max_key_matches=K), frequency), 2)
    return rows.select(*m.PLACE, F.size("offsets").alias("seeds"))


@query
def binned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by a binned index, merged with the hits that an index without bins allows: what that would find."""
    mask, path = Mask(MASK, depth=2), scratch(spark, "index")
    keys = stored(m.read_keys(reads(spark, sf_dir), mask), "read-keys")
    write_index(stored(m.sought_seeds(keys, texts(spark, sf_dir), mask), "sought"), mask, path)
    index, frequency, mask = read_index(spark, path)
    rows = m.merged_bins(m.placed_by_bin(keys, index, mask, m.MatchOptions(max_key_matches=K), frequency), K)
    return rows.select(*m.PLACE, F.size("offsets").alias("seeds"))


@query
def cals_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.in_range(matched(spark, sf_dir)[0], (100, 1), (400, 1000)).select("read_id", "contig", "position", "strand")


@query
def reference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.fetched(matched(spark, sf_dir)[0], align.chunks(reference(spark, sf_dir)))
    return found.select("read_id", "contig", "position", "strand", "window")


@query
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cals = matched(spark, sf_dir)[0].join(reads(spark, sf_dir), ["read_id", "end_no"]).withColumnRenamed("seq", "read")
    found = align.fetched(cals, align.chunks(reference(spark, sf_dir)))
    return found.where(align.is_exact(F.col("read"), F.col("window"), F.col("window_offset"))).select("read_id", "contig", "position", "strand")


@query
def mirrored_cals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mirrored(matched(spark, sf_dir, SECOND, halves(spark, sf_dir), k=64)[0], 40)


@query
def mapping_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.mapping_quality(scored(spark, sf_dir), F.lit(50.0), F.col("length"), F.lit(0))
    return found.select("read_id", "contig", "position", "strand", "score", "mapq")


@query
def unique_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.chosen(scored(spark, sf_dir), 2).select("read_id", "contig", "position", "strand")


@query
def unique_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.chosen(scored(spark, sf_dir), 3).select("read_id", "contig", "position", "strand", "score")


@query
def all_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.chosen(scored(spark, sf_dir), 4).select("read_id", "contig", "position", "strand", "score")


@query
def random_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.chosen(scored(spark, sf_dir).withColumn("mapq", F.lit(1)), 3, random_best=True).select("read_id", "contig", "position", "strand", "score", "mapq")


@query
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filtered(scored(spark, sf_dir), least_normalised=10, read_length=F.col("length")).select("read_id", "contig", "position", "strand")


@query
def mapped_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.mapped_ends(halves(spark, sf_dir), select.chosen(paired(spark, sf_dir), 3))


@query
def kept_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alignments of reads of which any end has one best place."""
    every = stored(paired(spark, sf_dir), "pairs")
    return select.kept_found(halves(spark, sf_dir), every, select.chosen(every, 3)).select("read_id", "end_no", "contig", "position", "strand", "score")


@query
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.distances(paired(spark, sf_dir))


@query
def insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("distance")
    return select.distances(paired(spark, sf_dir)).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"))


@query
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.scored_pairs(paired(spark, sf_dir), INSERT)
    return rows.select("read_id", "contig_1", "position_1", "strand_1", "contig_2", "position_2", "strand_2", "pair_score")


@query
def proper_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.pairs(paired(spark, sf_dir))
    return rows.select("read_id", "contig_1", "position_1", "strand_1", "contig_2", "position_2", "strand_2", select.proper(rows, INSERT).alias("proper"))


@query
def best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.scored_pairs(paired(spark, sf_dir), INSERT)
    return select.best_pairs(rows, 50, F.lit(40)).select("read_id", "contig_1", "position_1", "strand_1", "contig_2", "position_2", "strand_2", "pair_score", "mapq")


@query
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_distribution(scored(spark, sf_dir))


@query
def key_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = Mask("111111")
    return stats.reference_keys(reference(spark, sf_dir), six).select(key_text(F.col("key"), 6).alias("key"), "forward", "both")


@query
def key_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    twelve = Mask("1" * 12)
    return stats.reference_histogram(reference(spark, sf_dir), twelve)


ONE_WAY = Mask(ONE_WAY_MASK)


@query
def key_distribution_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a mask that doesn't read the same backwards."""
    found = stats.reference_keys(reference(spark, sf_dir), ONE_WAY)
    return found.select(key_text(F.col("key"), ONE_WAY.size).alias("key"), "forward", "both")


@query
def key_histogram_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reference_histogram(reference(spark, sf_dir), ONE_WAY)


@query
def tandem_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tandem_repeats(reference(spark, sf_dir))


@query
def chunked_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of contigs that are cut between tasks: those of whole ones."""
    return stats.tandem_repeats(reference(spark, sf_dir), chunk=500)


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = reference(spark, sf_dir).where(F.length("seq") > 60)
    place = (1 + (F.col("contig") * 7919) % (F.length("seq") - 60)).cast("int")
    cut = F.substring("seq", place, F.lit(60))
    truth = ref.select(F.col("contig").alias("read_id"), "contig", place.alias("position"), F.when(F.col("contig") % 2 == 0, "+").otherwise("-").alias("strand"), cut.alias("cut"))
    made = truth.select("read_id", F.lit(1).alias("end_no"), F.when(F.col("strand") == "-", bases.reverse_complement(F.col("cut"))).otherwise(F.col("cut")).alias("seq"))
    cals, _ = matched(spark, sf_dir, SECOND, made)
    return stats.accuracy(truth.withColumn("true_strand", F.col("strand")), cals, ["true_strand"])


@query
def expected_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    genome = float(stats.header(reference(spark, sf_dir)).first()["bases"])
    return reads(spark, sf_dir).select("read_id", bases.expected_random_hits(F.length("seq"), 15, F.lit(genome)).alias("expected"))


@query
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.header(reference(spark, sf_dir)).select(bases.index_bytes(F.col("bases"), F.col("contigs"), 8).cast("long").alias("bytes"))


@query
def illumina_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select(F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("name"), "seq", F.repeat(F.lit("h"), F.length("seq")).alias("qual"))
    return sequences.illumina_reads(rows, barcode=4, second=True)


@query
def barcode_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(sequences.barcode_length(reads(spark, sf_dir), share=0.2),)], "length int")


@query
def color_read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id")
    name = lambda end: F.concat(F.lit("bead_"), F.col("item_id").cast("string"), F.lit(end))
    left = items.where("item_id % 3 <> 0").select(name("_F3").alias("name"), F.col("item_id").cast("string").alias("value"))
    right = items.where("item_id % 3 <> 1").select(name("_R3").alias("name"), F.concat((F.col("item_id") % 40).cast("string"), F.lit(" -1")).alias("value"))
    return sequences.color_reads(left, right)


@query
def mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = bases.bits_to_mask(F.col("item_id"), F.lit(20))
    return table(spark, sf_dir, "benchmark").select("item_id", mask.alias("mask")).select("item_id", bases.mask_to_bits(F.col("mask")).alias("bits"), "mask")


@query
def sam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    bit = lambda n: F.floor(i / n) % 2 == 1
    flag = sam.flag(bit(1), bit(2), bit(4), bit(8), bit(16), bit(32), 1 + i % 3 % 2, i % 5 == 0)
    return table(spark, sf_dir, "benchmark").select("item_id", flag.alias("flag"))


@query
def seed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the places of near keys, how many each set of masks would have found."""
    cals = matched(spark, sf_dir, mismatches=1)[0].join(reads(spark, sf_dir), m.END).withColumnRenamed("seq", "read")
    found = align.fetched(cals, align.chunks(reference(spark, sf_dir)), offset=0).where(F.length("window") == F.length("read"))
    same = F.zip_with(F.split("read", ""), F.split("window", ""), lambda a, b: F.when(a == b, "1").otherwise("0"))
    return simulate.profile_accuracy(found.select(F.array_join(same, "").alias("profile")), ACCURATE).select("masks", "profiles", "found")


@query
def simulated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulated(reference(spark, sf_dir), 2, 50, snps=1, deletion=2, seed=7)


@query
def local_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from reads to chosen alignments with gaps."""
    return align_reads(reads(spark, sf_dir), reference(spark, sf_dir), SEED, algorithm=4, offset=15)


@query
def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = reads(spark, sf_dir).withColumn("name", F.concat(F.lit("read"), F.col("read_id").cast("string"))).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    contigs = reference(spark, sf_dir).select("contig", F.concat(F.lit("contig"), F.col("contig").cast("string")).alias("name"))
    found = align_reads(reads(spark, sf_dir), reference(spark, sf_dir), SEED, constrained=False)
    return sam.records(found, ends, contigs, algorithm=3).select("read_id", "end_no", "hit", "line")


@query
def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = halves(spark, sf_dir).withColumn("name", F.concat(F.lit("read"), F.col("read_id").cast("string"))).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    contigs = reference(spark, sf_dir).select("contig", F.concat(F.lit("contig"), F.col("contig").cast("string")).alias("name"))
    return sam.records(stored(paired_alignments(spark, sf_dir), "pairs"), ends, contigs).select("read_id", "end_no", "hit", "line")


@query
def color_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from colour reads to SAM records, with gaps and bound by seeds; written sorted by place, and read again."""
    ref, folder = reference(spark, sf_dir), scratch(spark, "sam")
    rows = color_reads_of(spark, sf_dir).withColumn("name", F.concat(F.lit("read"), F.col("read_id").cast("string"))).withColumn("qual", F.repeat(F.lit("I"), F.length("seq") - 1))
    contigs = ref.select("contig", F.concat(F.lit("contig"), F.col("contig").cast("string")).alias("name"), F.length("seq").alias("length"))
    sam.write_sam(sam.records(color_gapped_alignments(spark, sf_dir), rows, contigs, space="color", algorithm=4), contigs, folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query
def paired_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from the two ends of reads to their best pairs."""
    ends = halves(spark, sf_dir)
    found = scored_alignments(ends, reference(spark, sf_dir), SECOND, m.MatchOptions(max_key_matches=64), constrained=False, offset=10)
    return pairs_of(found, ends, insert=INSERT)


def match_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "match")
    reads(spark, sf_dir).write.parquet(f"{folder}/reads")
    build_index(texts(spark, sf_dir), SEED, f"{folder}/index")
    index, frequency, _ = read_index(spark, f"{folder}/index")
    stream = spark.readStream.schema("read_id long, end_no int, seq string").parquet(f"{folder}/reads")
    matching.match_stream(stream, index, frequency, SEED, f"{folder}/out", f"{folder}/state", m.MatchOptions(max_key_matches=K)).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("read_id", "end_no", "contig", "position", "strand", "mask")


QUERIES["match_stream"] = match_stream


@query
def stream_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of reads, from a stream of files to their best pairs: what ``paired_alignments`` finds in one batch."""
    folder = scratch(spark, "align")
    halves(spark, sf_dir).repartition(2, "read_id").write.parquet(f"{folder}/reads")
    stream = spark.readStream.schema("read_id long, end_no int, seq string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/reads")
    options = m.MatchOptions(max_key_matches=64)
    alignment.align_stream(stream, reference(spark, sf_dir), SECOND, f"{folder}/out", f"{folder}/state", INSERT, options=options, constrained=False, offset=10).awaitTermination()
    return spark.read.parquet(f"{folder}/out/pairs").drop("batch")


@query
def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as lines of text, and read again from files that are cut between tasks."""
    folder = scratch(spark, "lines")
    cals, ends = matched(spark, sf_dir)
    named = ends.select(*m.END, "max_reached").join(reads(spark, sf_dir), m.END)
    named = named.withColumn("name", F.col("read_id").cast("string")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    records.write_records(sequences.match_lines(m.with_mask(cals, SEED), named), folder)
    back, state = records.read_matches(spark, folder, 4096)
    joined = back.join(state.select("read_id", "end_no", F.col("name").cast("long").alias("item")), m.END)
    return joined.select(F.col("item").alias("read_id"), "end_no", "contig", "position", "strand", "mask")
