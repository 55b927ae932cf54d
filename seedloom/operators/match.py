"""Candidate locations of reads: seed join, repeat suppression, and the logic of candidate sets."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import mask_of, within
from ..storage import stored
from .blocks import likely, met
from .seeds import OUTSIDE, Likely, Mask, Sought, Texts, bin_of, key_frequency, read_keys, seeds
from .segments import Segments, cells_of

END = ["read_id", "end_no"]
PLACE = [*END, "contig", "position", "strand"]


@dataclass(frozen=True)
class MatchOptions:
    """Most hits of a key that still counts, most candidates of a read's end, and the share of its keys that may be missed; with ``mismatches`` a read's key
    stands for all that differ from it in so many bases or fewer, whose hits count together."""

    max_key_matches: int = 8
    max_matches: int = 384
    key_miss_fraction: float = 1.0
    strands: str = "+-"
    offsets: tuple[int, ...] | None = None
    space: str = "nt"
    mismatches: int = 0


#: Most keys that one may stand for.
MOST_NEIGHBOURS = 1 << 16


def neighbour_patterns(size: int, mismatches: int) -> list[int]:
    """What a key of ``size`` bases is combined with (exclusive or) for each key that differs from it in up to ``mismatches`` bases, itself first."""
    out = [0]
    for n in range(1, min(mismatches, size) + 1):
        for places in combinations(range(size), n):
            for changes in product((1, 2, 3), repeat=n):
                out.append(sum(c << 2 * p for c, p in zip(changes, places)))
                if len(out) > MOST_NEIGHBOURS:
                    raise ValueError(f"over {MOST_NEIGHBOURS} keys to one: allow fewer mismatches")
    return out


def query_keys(reads: DataFrame, mask: Mask, options: MatchOptions) -> DataFrame:
    """The keys that reads ask for: their own, and those near them. Two of one offset are never equal, since each differs from the read's own otherwise."""
    keys = read_keys(reads, mask, options.offsets, options.strands, options.space)
    if not options.mismatches:
        return keys
    every = F.lit(neighbour_patterns(mask.size, options.mismatches)).cast("array<bigint>")
    return keys.withColumn("key", F.explode(F.transform(every, lambda x: F.col("key").bitwiseXOR(x))))


def key_hits(keys: DataFrame, frequency: DataFrame) -> DataFrame:
    """Keys of reads with ``hits``: how often an offset's key occurs, over the strands together."""
    found = keys.join(frequency, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("hits", F.sum("n").over(Window.partitionBy(*END, "offset")))


def end_flags(hits: DataFrame, options: MatchOptions) -> DataFrame:
    """read_id, end_no, max_reached: -1 if an end has a key of too many matches, or misses too many keys; else 255 times the share missed.

    A key that occurs more than ``max_key_matches`` times is missed.
    """
    keys = hits.groupBy(*END, "offset").agg(F.max("hits").alias("hits"))
    missed = F.col("hits") > options.max_key_matches
    summed = keys.groupBy(*END).agg(
        F.count_if(missed).alias("missed"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.max((~missed & (F.col("hits") > options.max_matches)).cast("int")), F.lit(0)).alias("over")
    )
    return summed.select(*END, "missed", "keys", _flag(F.col("missed"), F.col("keys"), F.col("over"), options).alias("max_reached"))


def _flag(missed: Column, keys: Column, over: Column, options: MatchOptions) -> Column:
    share = missed / keys
    return F.when((over == 1) | (share > options.key_miss_fraction), -1).otherwise((F.lit(255) * share).cast("int"))


def placed(hits: DataFrame, index: DataFrame, mask: Mask, options: MatchOptions) -> DataFrame:
    """Keys that aren't missed, joined to the index: read_id, end_no, length, offset, strand, contig, position (where the read begins).

    Very common keys go before the join: it makes at most ``max_key_matches`` rows of a key.
    """
    few = hits.where((F.col("n") > 0) & (F.col("hits") <= options.max_key_matches)).select(*END, "length", "offset", "strand", "key")
    return _places(few.join(index.select("key", "contig", "pos"), "key"), mask, options)


def _places(joined: DataFrame, mask: Mask, options: MatchOptions, *more: str) -> DataFrame:
    # A colour lies between two bases: forward, the read begins a base before its first usable colour; backward, it ends one before the window's first.
    color = options.space == "color"
    forward = F.col("pos") - F.col("offset") - (1 if color else 0)
    backward = F.col("pos") + (mask.width + F.col("offset")) - F.col("length")
    position = F.when(F.col("strand") == "+", forward).otherwise(backward)
    return joined.select(*END, "length", "offset", "strand", "contig", position.alias("position"), *more)


def united(rows: DataFrame) -> DataFrame:
    """One row per place with all its offsets, sorted: read_id, end_no, contig, position, strand, length, offsets."""
    return rows.groupBy(*PLACE).agg(F.max("length").alias("length"), F.sort_array(F.collect_set("offset")).alias("offsets"))


def capped(cals: DataFrame, flags: DataFrame, max_matches: int) -> tuple[DataFrame, DataFrame]:
    """Ends with a flag, or with more than ``max_matches`` candidates, lose them all and are flagged."""
    counts = cals.groupBy(*END).agg(F.count(F.lit(1)).alias("cals"))
    over = flags.join(counts, END, "left").withColumn("cals", F.coalesce("cals", F.lit(0)))
    flag = F.when(F.col("cals") > max_matches, -1).otherwise(F.col("max_reached"))
    ends = over.select(*END, flag.alias("max_reached"), F.when(flag < 0, 0).otherwise(F.col("cals")).cast("long").alias("cals"))
    return cals.join(ends.where("max_reached >= 0").select(*END), END, "left_semi"), ends


def match(reads: DataFrame, index: DataFrame | Segments, frequency: DataFrame | Segments, mask: Mask, options: MatchOptions = MatchOptions()) -> tuple[DataFrame, DataFrame]:
    """(candidates, ends): places of reads (read_id, end_no, seq) by one index, and the state of each end with a key.

    Of a stored index (``read_index``: its seeds have a ``bin``) only the bins of the reads' keys are read, and no seed is shuffled but those sought. Keys with
    their hits, and candidates, are written between the steps: both are read twice.
    """
    keys = query_keys(reads, mask, options)
    if "bin" not in index.columns:
        return _matched(keys, index, frequency, mask, options)
    keys = stored(keys, "read-keys")
    hits = stored(key_hits(keys, stored(of_keys(frequency, keys, mask).select("key", "n"), "frequency")), "hits")
    few = hits.where((F.col("n") > 0) & (F.col("hits") <= options.max_key_matches))
    return _found(hits, stored(of_keys(index, few, mask), "sought"), mask, options)


def of_keys(stored_rows: DataFrame | Segments, keys: DataFrame, mask: Mask) -> DataFrame:
    """Rows of a stored index (with ``bin`` and ``key``) whose key is among ``keys``, found where they lie.

    The bins of the keys, of which a mask has 4**depth at most, are told first: no other is read. Keys are brought to the index's blocks by cell: those of up to
    MOST_SOUGHT distinct keys are sent to every task; more are dealt to the index's buckets, and each is looked up in its own.
    """
    sought = stored(keys.select("key").distinct(), "sought-keys")
    bins = [r["bin"] for r in sought.select(bin_of(F.col("key"), mask).alias("bin")).distinct().collect()]
    few = sought.count() <= MOST_SOUGHT
    if isinstance(stored_rows, Segments):
        cells = stored(cells_of(sought, mask), "sought-cells")
        return stored_rows.of_keys(sought, F.broadcast(cells) if few else cells.hint("shuffle_hash"), bins)
    return stored_rows.where(F.col("bin").isin([*bins, OUTSIDE])).join(F.broadcast(sought) if few else sought, "key", "left_semi")


def _matched(keys: DataFrame, index: DataFrame, frequency: DataFrame, mask: Mask, options: MatchOptions) -> tuple[DataFrame, DataFrame]:
    return _found(stored(key_hits(keys, frequency), "hits"), index, mask, options)


def _found(hits: DataFrame, index: DataFrame, mask: Mask, options: MatchOptions) -> tuple[DataFrame, DataFrame]:
    cals = stored(united(placed(hits, index, mask, options)), "candidates")
    return capped(cals, end_flags(hits, options).select(*END, "max_reached"), options.max_matches)


#: Distinct keys of reads that may go to every task (8 bytes each); more are joined.
MOST_SOUGHT = 1 << 20


def sought_seeds(keys: DataFrame, reference: DataFrame | Texts, mask: Mask, repeat_masker: bool = False, space: str = "nt") -> DataFrame:
    """The seeds of ``reference`` whose key is among ``keys``: the reference is scanned once, and other seeds don't leave the scan.

    Up to MOST_SOUGHT distinct keys are counted and sent to every task; if there are more, a table of their hashes is, and what it lets through meets the keys in a join.
    """
    shared = _shared(keys, reference)
    found = seeds(reference, mask, repeat_masker, shared, space)
    if isinstance(shared.value, Sought):
        return found
    return found.join(keys.select("key").distinct(), "key", "left_semi").select("contig", "pos", "key")


def _shared(keys: DataFrame, reference: DataFrame | Texts) -> Broadcast:
    """The distinct keys for every task (``Sought``), if they are at most MOST_SOUGHT, else a table of their hashes (``Likely``)."""
    known: Sought | Likely | None = None
    told = keys.agg(F.approx_count_distinct("key").alias("about"), F.count(F.lit(1)).alias("n")).first()
    if told["about"] <= 2 * MOST_SOUGHT:  # an estimate far above it needs no shuffle of the keys to be believed: either way finds the same
        few = keys.select("key").distinct().limit(MOST_SOUGHT + 1).toArrow()
        if few.num_rows <= MOST_SOUGHT:
            known = Sought(few.column("key").to_numpy())
    if known is None:
        known = likely(keys, told["n"])
    return reference.sparkSession.sparkContext.broadcast(known)


def match_reference(reads: DataFrame, reference: DataFrame | Texts, mask: Mask, options: MatchOptions = MatchOptions(), repeat_masker: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``match``, for a reference (contig, seq) without a stored index: only seeds that the reads ask for are kept and counted.

    If the reads have over MOST_SOUGHT distinct keys, these and the seeds meet in blocks (``blocks.met``), and what is found is dealt once, by end.
    """
    keys = stored(query_keys(reads, mask, options), "read-keys")
    shared = _shared(keys, reference)
    if isinstance(shared.value, Sought):
        index = stored(seeds(reference, mask, repeat_masker, shared, options.space), "sought")
        return _matched(keys, index, key_frequency(index), mask, options)
    asked = keys.withColumn("strand", (F.col("strand") == "-").cast("int"))
    found = met(reference, asked, mask, [*END, "length", "offset", "strand"], options.max_key_matches, repeat_masker, options.space, shared)
    hits = found.select("read_id", *[F.col(c).cast("int").alias(c) for c in ("end_no", "length", "offset", "strand")], "n", "contigs", "places")
    hits = hits.repartition(*END).withColumn("hits", F.sum("n").over(Window.partitionBy(*END, "offset")))
    missed = F.col("hits") > options.max_key_matches
    # An end's missed offsets are a row with no place.
    placed_ = hits.withColumn("_at", F.when(~missed, F.arrays_zip("contigs", "places"))).select("*", F.explode_outer("_at").alias("_seed"))
    placed_ = placed_.withColumn("contig", F.col("_seed.contigs")).withColumn("pos", F.col("_seed.places")).withColumn("strand", F.when(F.col("strand") == 1, "-").otherwise("+"))
    placed_ = _places(placed_, mask, options, "hits").withColumn("strand", F.when(F.col("contig").isNotNull(), F.col("strand")))
    over = F.max(F.coalesce(F.col("contig").isNotNull() & (F.col("hits") > options.max_matches), F.lit(False)).cast("int")).alias("over")
    rows = placed_.groupBy(*PLACE).agg(F.max("length").alias("length"), F.sort_array(F.collect_set("offset")).alias("offsets"), over)
    rows = stored(rows, "candidates")
    no_place = F.col("contig").isNull()
    states = rows.groupBy(*END).agg(F.max(F.when(no_place, F.size("offsets")).otherwise(0)).alias("missed"), F.max("over").alias("over"))
    asked_for = keys.groupBy(*END).agg(F.size(F.collect_set("offset")).alias("keys")).join(states, END, "left")
    flags = asked_for.select(*END, _flag(F.coalesce("missed", F.lit(0)), F.col("keys"), F.coalesce("over", F.lit(0)), options).alias("max_reached"))
    return capped(rows.where(~no_place).drop("over"), flags, options.max_matches)


def with_mask(cals: DataFrame, mask: Mask, space: str = "nt") -> DataFrame:
    """Candidates with ``mask``: which places of the read their seeds cover. In colour space offset 0 is the second colour, so places are one on."""
    offsets = F.transform("offsets", lambda o: o + 1) if space == "color" else F.col("offsets")
    return cals.withColumn("mask", mask_of(offsets, F.col("length"), mask.text, F.col("strand")))


def merged(parts: list[tuple[DataFrame, DataFrame]], max_matches: int) -> tuple[DataFrame, DataFrame]:
    """Results of several indexes as one. cals: (..., mask); the masks of a place are united, bit by bit. An end flagged by any index is flagged."""
    cals, ends = parts[0]
    for c, e in parts[1:]:
        cals, ends = cals.unionByName(c), ends.unionByName(e)
    together = cals.groupBy(*PLACE).agg(F.max("length").alias("length"), F.collect_set("mask").alias("masks"))
    either = F.array_join(
        F.transform(F.sequence(F.lit(1), F.col("length")), lambda p: F.when(F.exists("masks", lambda m: F.substring(m, p, F.lit(1)) == "1"), "1").otherwise("0")), ""
    )
    flags = ends.groupBy(*END).agg(F.when(F.min("max_reached") < 0, -1).otherwise(F.max("max_reached")).alias("max_reached"))
    return capped(together.withColumn("mask", either).drop("masks"), flags, max_matches)


def with_fallback(reads: DataFrame, main: tuple[DataFrame, DataFrame], second) -> tuple[DataFrame, DataFrame]:
    """``main``, and for reads without a candidate there what ``second(reads)`` finds."""
    cals, ends = main
    again = reads.join(cals.select("read_id").distinct(), "read_id", "left_anti")
    more, more_ends = second(again)
    kept = ends.join(again.select(*END).distinct(), END, "left_anti")
    return cals.unionByName(more), kept.unionByName(more_ends)


def placed_by_bin(keys: DataFrame, index: DataFrame, mask: Mask, options: MatchOptions, frequency: DataFrame | None = None) -> DataFrame:
    """``placed`` rows by an index in bins (seeds with ``bin``), which is read only in the bins that reads ask for. Hits are summed over bins, as those of an
    index without bins. Without ``frequency``, as stored with the index, the keys sought are counted."""
    own = stored(of_keys(index, keys, mask), "sought")
    n = key_frequency(own) if frequency is None else of_keys(frequency, keys, mask).select("key", "n")
    return placed(stored(key_hits(keys, n), "hits"), own, mask, options)


def merged_bins(rows: DataFrame, max_key_matches: int) -> DataFrame:
    """placed rows of all bins together: a place stays with the offsets whose hits over all bins are few enough."""
    hits = F.count(F.lit(1)).over(Window.partitionBy(*END, "offset"))
    return united(rows.withColumn("hits", hits).where(F.col("hits") <= max_key_matches).drop("hits"))


def in_range(cals: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Candidates that begin within the inclusive range of (contig, position)."""
    return cals.where(within(F.col("contig"), F.col("position"), start, end))


def mirrored(cals: DataFrame, distance: int) -> DataFrame:
    """Candidates of ends 1 and 2 with those that each end's places imply for the other, ``distance`` further along the strand."""
    step = F.when(F.col("strand") == "+", distance).otherwise(-distance) * F.when(F.col("end_no") == 1, 1).otherwise(-1)
    other = cals.where("end_no in (1, 2)").select("read_id", (3 - F.col("end_no")).alias("end_no"), "contig", (F.col("position") + step).alias("position"), "strand", F.lit(True).alias("implied"))
    every = cals.select(*PLACE, F.lit(False).alias("implied")).unionByName(other)
    return every.where("position > 0").groupBy(*PLACE).agg(F.min("implied").alias("implied"))
