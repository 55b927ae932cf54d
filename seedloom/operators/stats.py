"""Reports: keys of a reference, score distributions, tandem repeats, accuracy against known truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .blocks import counted_keys, counted_strands
from .seeds import Mask, cut_contigs, key_frequency, seeds


def turned_key(key: Column, mask: Mask) -> Column:
    """The key of the same bases read from the other strand."""
    out = F.lit(0).cast("long")
    for i in range(mask.size):
        base = F.shiftright(key, 2 * i).bitwiseAND(F.lit(3))
        out = F.shiftleft(out, 2).bitwiseOR(F.lit(3) - base)
    return out


def turned_seeds(reference: DataFrame, mask: Mask, repeat_masker: bool = False) -> DataFrame:
    """contig, pos, key of the reference's windows read from the other strand: what ``mask`` covers there is what it covers, turned round, here."""
    return seeds(reference, Mask(mask.text[::-1]), repeat_masker).withColumn("key", turned_key(F.col("key"), mask))


def strand_keys(index: DataFrame, turned: DataFrame) -> DataFrame:
    """key, forward, both: occurrences of each key on the forward strand, where it may have none, and on both. ``turned``: as ``turned_seeds`` gives it."""
    n = index.groupBy("key").agg(F.count(F.lit(1)).alias("forward"))
    m = turned.groupBy("key").agg(F.count(F.lit(1)).alias("backward"))
    forward, backward = (F.coalesce(c, F.lit(0)) for c in ("forward", "backward"))
    return n.join(m, "key", "full_outer").select("key", forward.alias("forward"), (forward + backward).alias("both"))


def key_distribution(index: DataFrame, mask: Mask, turned: DataFrame | None = None) -> DataFrame:
    """key, forward, both: occurrences of each key of the index, and of it or its reverse complement.

    With a mask that reads the same backwards the index tells both, and a key that is its own reverse complement counts once. Any other mask
    covers other bases from the other strand; then ``turned``, those windows' keys, is needed, and keys that occur there alone are told, too.
    """
    if mask.text != mask.text[::-1]:
        if turned is None:
            raise ValueError("a mask that doesn't read the same backwards needs the other strand's keys")
        return strand_keys(index, turned)
    return _both(key_frequency(index), mask)


def _both(n: DataFrame, mask: Mask) -> DataFrame:
    """``key_distribution`` from key, n of a mask that reads the same backwards."""
    n = n.withColumnRenamed("n", "forward")
    other = n.select(turned_key(F.col("key"), mask).alias("key"), F.col("forward").alias("backward"))
    palindrome = F.col("key") == turned_key(F.col("key"), mask)
    both = F.col("forward") + F.when(palindrome, 0).otherwise(F.coalesce("backward", F.lit(0)))
    return n.join(other, "key", "left").select("key", "forward", both.alias("both"))


def key_histogram(index: DataFrame, mask: Mask, turned: DataFrame | None = None) -> DataFrame:
    """times, keys: how many keys occur so often on both strands together. A key and its reverse complement are one, but for a mask that doesn't read the same
    backwards, which needs ``turned``: there each key of either strand is one."""
    if mask.text != mask.text[::-1]:
        return _times(key_distribution(index, mask, turned).select("key", F.col("both").alias("times")))
    return _folded(key_frequency(index), mask)


def _folded(n: DataFrame, mask: Mask) -> DataFrame:
    least = F.least(F.col("key"), turned_key(F.col("key"), mask))
    return _times(n.groupBy(least.alias("key")).agg(F.sum("n").alias("times")))


def _times(n: DataFrame) -> DataFrame:
    return n.groupBy("times").agg(F.count(F.lit(1)).alias("keys"))


def reference_keys(reference: DataFrame, mask: Mask, repeat_masker: bool = False) -> DataFrame:
    """``key_distribution`` of a reference's seeds, counted in blocks."""
    if mask.text != mask.text[::-1]:
        n = counted_strands(reference, mask, repeat_masker)
        return n.select("key", "forward", (F.col("forward") + F.col("backward")).alias("both"))
    return _both(stored(counted_keys(reference, mask, repeat_masker), "key-counts"), mask)


def reference_histogram(reference: DataFrame, mask: Mask, repeat_masker: bool = False) -> DataFrame:
    """``key_histogram`` of a reference's seeds, counted in blocks."""
    if mask.text != mask.text[::-1]:
        return _times(reference_keys(reference, mask, repeat_masker).select("key", F.col("both").alias("times")))
    return _folded(counted_keys(reference, mask, repeat_masker), mask)


def score_distribution(alignments: DataFrame, start: int = -2000, step: int = 10, end: int = 2000) -> DataFrame:
    """n_cals, bucket, alignments: scores from ``start`` to ``end`` in steps, by how many alignments their end has."""
    n = F.count(F.lit(1)).over(Window.partitionBy("read_id", "end_no"))
    bucket = ((F.least(F.greatest(F.col("score"), F.lit(start)), F.lit(end)) - start) / step).cast("int")
    return alignments.select(n.alias("n_cals"), bucket.alias("bucket")).groupBy("n_cals", "bucket").agg(F.count(F.lit(1)).alias("alignments"))


REPEATS = "contig long, start long, stop long, length long, unit_length int, unit string"
REPEAT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def _recurs(s: np.ndarray, own: int, u: int) -> np.ndarray:
    """Whether each of the first ``own`` bases comes again ``u`` on."""
    same = np.zeros(own, bool)
    n = min(own, len(s) - u)
    if n > 0:
        same[:n] = s[:n] == s[u : u + n]
    return same


def _places(s: np.ndarray, own: int, behind: dict[int, int], least_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and unit of the longest run from each own base, 0 without one. behind: by unit, how many places recur in a row from the first base that isn't own."""
    length, unit, at = np.zeros(own, np.int64), np.zeros(own, np.int64), np.arange(own)
    for u in sorted(behind):
        stops = np.where(_recurs(s, own, u), own + behind[u], at)
        ahead = np.minimum.accumulate(stops[::-1])[::-1] - at
        run = u * (1 + ahead // u)
        better = (run >= least_length) & (run > u) & (run > length) & (s[:own] != ord("n"))
        length[better], unit[better] = run[better], u
    return length, unit


def _after(before: tuple[int, int, int] | None, now: tuple[int, int, int]) -> bool:
    """Whether a run (start, length, unit) stands beside the last one: it doesn't end within it, and isn't it moved by a base."""
    if before is None:
        return True
    moved = now[0] == before[0] + 1 and now[1:] == before[1:]
    return not moved and now[0] + now[1] > before[0] + before[1]


def tandem_repeats(reference: DataFrame, least_unit: int = 1, most_unit: int = 6, least_length: int = 12, chunk: int | None = None) -> DataFrame:
    """reference (contig, seq) -> contig, start, stop, length, unit_length, unit: runs of a repeated unit.

    At each place the unit with the longest run counts, the shortest of equals; a run is passed over if it ends within the last one's, or is the
    last one's moved by a base.

    With ``chunk`` contigs are cut into chunks of so many bases, which many tasks read. How far a unit recurs beyond a chunk is told from
    counts of the chunks behind it, so a run may go over any number of them; and a chunk's first run is held against the last one of those before it.
    """
    if chunk:
        return _stitched_repeats(reference, least_unit, most_unit, least_length, chunk)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for contig, seq in zip(b.column("contig").to_pylist(), b.column("seq").to_pylist()):
                text = (seq or "").lower()
                s = np.frombuffer(text.encode(), np.uint8)
                length, unit = _places(s, len(s), dict.fromkeys(range(least_unit, most_unit + 1), 0), least_length)
                before = None
                for at in np.nonzero(length)[0].tolist():
                    now = (at, int(length[at]), int(unit[at]))
                    if _after(before, now):
                        out.append((contig, at + 1, at + now[1], now[1], now[2], text[at : at + now[2]]))
                    before = now
            columns = list(zip(*out)) if out else [[] for _ in REPEAT_KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, REPEAT_KINDS)], names=["contig", "start", "stop", "length", "unit_length", "unit"])

    return reference.select(F.col("contig").cast("long").alias("contig"), "seq").mapInArrow(runs, REPEATS)


def _stitched_repeats(reference: DataFrame, least_unit: int, most_unit: int, least_length: int, chunk: int) -> DataFrame:
    units = list(range(least_unit, most_unit + 1))
    pieces = stored(cut_contigs(reference, most_unit, chunk, 0), "chunks")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By chunk and unit: where the first base is that doesn't recur, if there is one."""
        for b in batches:
            rows = []
            for contig, start, own, seq in zip(*(b.column(c).to_pylist() for c in ("contig", "start", "own", "seq"))):
                s = np.frombuffer(seq.lower().encode(), np.uint8)
                for u in units:
                    ends = np.nonzero(~_recurs(s, own, u))[0]
                    rows.append((contig, start, own, u, start + int(ends[0]) if len(ends) else None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["contig", "start", "own", "u", "stop"])

    told = pieces.mapInArrow(borders, "contig long, start long, own int, u int, stop long")
    # A row for each chunk and unit from here on.
    later = Window.partitionBy("contig", "u").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    behind = F.coalesce(F.first("stop", ignorenulls=True).over(later) - F.col("start") - F.col("own"), F.lit(0))
    ahead = told.withColumn("behind", behind).groupBy("contig", "start").agg(F.map_from_entries(F.collect_list(F.struct("u", "behind"))).alias("behind"))
    schema = REPEATS + ", chunk long, first boolean, last boolean, kept boolean"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of each chunk that are kept, and its first and its last one, kept or not."""
        for b in batches:
            out = []
            for contig, start, own, seq, far in zip(*(b.column(c).to_pylist() for c in ("contig", "start", "own", "seq", "behind"))):
                text = seq.lower()
                s = np.frombuffer(text.encode(), np.uint8)
                length, unit = _places(s, own, dict(far), least_length)
                found, before = np.nonzero(length)[0].tolist(), None
                for k, at in enumerate(found):
                    now = (at, int(length[at]), int(unit[at]))
                    kept, last = _after(before, now), k == len(found) - 1
                    if kept or last:
                        out.append((contig, start + at, start + at + now[1] - 1, now[1], now[2], text[at : at + now[2]], start, k == 0, last, kept))
                    before = now
            columns = list(zip(*out)) if out else [[]] * 10
            kinds = [*REPEAT_KINDS, pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    found = stored(pieces.join(ahead, ["contig", "start"]).mapInArrow(runs, schema), "runs")
    # A chunk's last run, held against the first of the next chunk that has one.
    along = Window.partitionBy("contig").orderBy("chunk")
    run = F.struct("start", "length", "unit_length")
    ends = found.where("first or last").groupBy("contig", "chunk").agg(F.max(F.when(F.col("first"), run)).alias("now"), F.max(F.when(F.col("last"), run)).alias("own_last"))
    ends = ends.withColumn("was", F.lag("own_last").over(along))
    now, was = F.col("now"), F.col("was")
    moved = (now["start"] == was["start"] + 1) & (now["length"] == was["length"]) & (now["unit_length"] == was["unit_length"])
    beside = was.isNull() | (~moved & (now["start"] + now["length"] > was["start"] + was["length"]))
    gone = ends.where(~beside).select("contig", F.col("now")["start"].alias("start"))
    return found.where("kept").join(gone, ["contig", "start"], "left_anti").select("contig", "start", "stop", "length", "unit_length", "unit")


#: How far off a place may be to count as right, in each of the columns.
TOLERANCES = (0, 10, 100, 1000, 10000)


def accuracy(truth: DataFrame, alignments: DataFrame, classes: list[str]) -> DataFrame:
    """truth: read_id, contig, position, strand and ``classes``; one end. Reads, those aligned, and those with a place within each tolerance, by class."""
    t = truth.select("read_id", F.col("contig").alias("_c"), F.col("position").alias("_p"), F.col("strand").alias("_s"), *classes)
    joined = t.join(alignments.select("read_id", "contig", "position", "strand"), "read_id", "left")
    off = F.when((F.col("contig") == F.col("_c")) & (F.col("strand") == F.col("_s")), F.abs(F.col("position") - F.col("_p")))
    reads = joined.groupBy("read_id", *classes).agg(F.min(off).alias("off"), F.count("contig").alias("n"))
    within = [F.count_if(F.col("off") <= k).alias(f"within_{k}") for k in TOLERANCES]
    return reads.groupBy(*classes).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("n") > 0).alias("aligned"), *within)


def against_expected(scored: DataFrame) -> DataFrame:
    """scored: score, expected -> how many alignments score less than, as, and more than the truth."""
    return scored.agg(*[F.count_if(c).alias(n) for n, c in (("less", F.col("score") < F.col("expected")), ("equal", F.col("score") == F.col("expected")), ("greater", F.col("score") > F.col("expected")))])


def header(reference: DataFrame) -> DataFrame:
    """contigs, bases of a reference."""
    return reference.agg(F.count(F.lit(1)).alias("contigs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))
