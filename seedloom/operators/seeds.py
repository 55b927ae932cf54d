"""Spaced seeds: keys of every window of a reference, and of reads.

A mask of 0 and 1 tells which bases of a window make its key, two bits a base. Windows are cut inside
Arrow batches with whole-array operations, so a long contig costs no more per base than a short one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Windows cut at once.
BATCH = 1 << 16


@dataclass(frozen=True)
class Mask:
    """A spaced seed. Begins and ends with 1; its key has to fit 62 bits."""

    text: str
    depth: int = 0
    hash_width: int = 0

    def __post_init__(self):
        t = self.text
        if not t or set(t) - {"0", "1"} or t[0] != "1" or t[-1] != "1":
            raise ValueError(f"a mask is 0s between 1s: {t!r}")
        if self.size > 31:
            raise ValueError("at most 31 bases to a key")
        if self.hash_width and self.size < self.hash_width + self.depth:
            raise ValueError("key size is below hash width and depth")

    @property
    def width(self) -> int:
        return len(self.text)

    @property
    def size(self) -> int:
        return self.text.count("1")

    @property
    def places(self) -> list[int]:
        return [i for i, c in enumerate(self.text) if c == "1"]

    def truncated(self, key_size: int) -> Mask:
        """The mask up to its ``key_size``-th 1, if it has more and the hash prefix fits."""
        if key_size <= 0 or key_size >= self.size or key_size < self.hash_width:
            return self
        return Mask(self.text[: self.places[key_size - 1] + 1], self.depth, self.hash_width)


def _table() -> np.ndarray:
    """Code of each byte; 4 for what is no base, and 8 more for lower case."""
    t = np.full(256, 4, np.uint8)
    t[list(b"ACGT")] = range(4)
    t[list(b"acgt")] = [8, 9, 10, 11]
    t[ord("n")] = 12
    return t


CODES = _table()


def color_codes(codes: np.ndarray, before: int = 0, at: np.ndarray | int = 0) -> np.ndarray:
    """Codes of the colours of bases, each against the one before it (``before``, A, at the first of a contig: places ``at``): 4 where either is no base, 8 more
    where either is lower case."""
    last = np.concatenate([codes[:1], codes[:-1]])
    last[at] = before
    unknown, repeat = (last | codes) & 4, (last | codes) & 8
    return np.where(unknown, 4, (last ^ codes) & 3).astype(np.uint8) | repeat


def _runs(places: Sequence[int]) -> list[tuple[int, int, int]]:
    """``places`` as runs of neighbours: least place, length, and 1 or -1 as they rise or fall."""
    out, at = [], 0
    while at < len(places):
        step = places[at + 1] - places[at] if at + 1 < len(places) and abs(places[at + 1] - places[at]) == 1 else 1
        end = at + 1
        while end < len(places) and places[end] - places[end - 1] == step:
            end += 1
        out.append((min(places[at], places[end - 1]), end - at, step))
        at = end
    return out


def _keys(codes: np.ndarray, places: Sequence[int], n: int, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows that start at each of the first n codes, and which of them are valid. Neighbouring places are joined by halves, in as few bits as hold them."""
    bases, wrong = codes & 3, (codes & 4) != 0
    if repeats:
        wrong |= codes >= 8
    told: dict[tuple[int, int], np.ndarray] = {(1, 1): bases, (1, -1): bases}

    def joined(length: int, step: int) -> np.ndarray:
        if (length, step) not in told:
            low = length // 2
            high = length - low
            kind = np.uint8 if length <= 4 else np.uint16 if length <= 8 else np.uint32 if length <= 16 else np.int64
            first, second, size = joined(high, step), joined(low, step), len(codes) - length + 1
            first, second = (first[:size], second[high : high + size]) if step > 0 else (first[low : low + size], second[:size])
            told[length, step] = (first.astype(kind) << (2 * low)) | second
        return told[length, step]

    keys = np.zeros(n, np.int64)
    for at, length, step in _runs(places):
        keys <<= 2 * length
        keys |= joined(length, step)[at : at + n]
    bad = np.zeros(n, bool)
    if wrong.any():
        for p in places:
            bad |= wrong[p : p + n]
    return keys, ~bad


#: Bits of a key's hash that tell quickly that it isn't sought.
QUICK = 22


def _hashed(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - QUICK)


class Sought:
    """A set of keys, as a sorted array and a table of hash bits that settles nearly all others."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.quick = np.unique(keys), np.zeros(1 << QUICK, bool)
        self.quick[_hashed(self.keys)] = True

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys`` whose key is sought."""
        at = np.nonzero(self.quick[_hashed(keys)])[0]
        if not len(at) or not len(self.keys):
            return at[:0]
        found = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        return at[self.keys[found] == keys[at]]


#: Most bits of a table that tells keys that can't be sought: bounded, as every task holds it (32 MB).
LIKELY = 28


class Likely:
    """Bits of the hashes of a set of keys: what isn't among them isn't sought, the rest may be."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def hashed(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys`` whose key may be sought."""
        h = self.hashed(keys, self.bits)
        byte = self.table[(h >> np.uint64(3)).astype(np.int64)]
        return np.nonzero((byte >> (h & np.uint64(7)).astype(np.uint8)) & 1)[0]


#: Bases of a chunk of a contig that is cut between tasks.
CHUNK = 1 << 20
CUT = "contig long, start long, lead int, own int, seq string"


def cut_contigs(reference: DataFrame, after: int, size: int = CHUNK, before: int = 1) -> DataFrame:
    """reference (contig, seq) -> contigs in chunks of ``size`` bases that are dealt to all tasks: contig, start (from 1), lead, own, seq.

    ``seq`` holds ``lead`` bases before the chunk's own (up to ``before``), its ``own`` from place ``start`` on, and up to ``after`` behind them, so that
    what begins at an own base is told by the chunk alone. An empty contig has one chunk.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for contig, seq in zip(b.column("contig").to_pylist(), b.column("seq").to_pylist()):
                seq, rows = seq or "", []
                for at in range(0, max(len(seq), 1), size):
                    lead = min(before, at)
                    rows.append((contig, at + 1, lead, min(size, len(seq) - at), seq[at - lead : at + size + after]))
                    if len(rows) * size >= 1 << 24 or at + size >= len(seq):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["contig", "start", "lead", "own", "seq"])
                        rows = []

    whole = reference.select(F.col("contig").cast("long").alias("contig"), "seq").mapInArrow(cut, CUT)
    return whole.repartition("contig", "start")


@dataclass(frozen=True)
class Texts:
    """Contigs as texts (``rows``: contig, text) that the scan itself turns into bases, so that these don't go out of a task and in again. ``table``: the base of each
    byte, 0 for what is left out."""

    rows: DataFrame
    table: np.ndarray
    columns = ("contig", "text")

    @property
    def sparkSession(self):  # noqa: N802
        return self.rows.sparkSession


def turned_texts(text: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of texts end to end, and where each text's begin and end. A null text has none."""
    filled = text.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    made = table[np.frombuffer(filled.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    kept = made != 0
    return made[kept], np.concatenate([[0], np.cumsum(kept)])[ends - ends[0]]


def seeds(reference: DataFrame | Texts, mask: Mask, repeat_masker: bool = False, sought: Broadcast | None = None, space: str = "nt") -> DataFrame:
    """reference (contig long, seq) -> contig, pos (from 1), key: each window whose key has no N (nor, with ``repeat_masker``, a lower-case base).

    ``reference`` may be cut by ``cut_contigs`` with at least a mask's width less one behind each chunk; the result is the same, by more tasks.
    With ``sought`` (a broadcast ``Sought``) only windows of those keys leave the scan. With ``space`` "color", ``seq`` is still bases, and keys are of
    their colours; a colour is a repeat where either of its bases is.
    """
    chunked = "lead" in reference.columns
    cut = _cutter(mask, repeat_masker, sought, space, chunked, table=_table_of(reference))
    return _scanned(reference).mapInArrow(cut, "contig long, pos int, key long")


def _table_of(reference: DataFrame | Texts) -> np.ndarray | None:
    return reference.table if isinstance(reference, Texts) else None


def _scanned(reference: DataFrame | Texts) -> DataFrame:
    if isinstance(reference, Texts):
        return reference.rows.select(F.col("contig").cast("long").alias("contig"), "text")
    columns = ["seq", "start", "lead", "own"] if "lead" in reference.columns else ["seq"]
    return reference.select(F.col("contig").cast("long").alias("contig"), *columns)


def _cutter(mask: Mask, repeat_masker: bool, sought: Broadcast | None, space: str, chunked: bool, turned: bool = False, table: np.ndarray | None = None):
    """Batches of contigs -> batches of seeds, as ``seeds`` tells them. A batch's contigs lie end to end and are cut together, BATCH windows at a time.
    ``turned``: keys of the windows read from the other strand, by a ``mask`` that is turned round already. ``table``: what makes bases of texts (see ``Texts``), a thousand at a time."""
    width, places = mask.width, mask.places[::-1] if turned else mask.places

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if table is None else (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            if table is not None:
                whole, ends = turned_texts(b.column("text"), table)
            else:
                text = b.column("seq").cast(pa.large_binary()).fill_null(b"")
                ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            if not len(whole):
                continue
            starts, stops = ends[:-1] - ends[0], ends[1:] - ends[0]
            contigs = b.column("contig").to_numpy(zero_copy_only=False)
            first, last, shift = starts, stops - width + 1, 1 - starts  # windows that may begin, and what makes a place of theirs
            if chunked:
                start, lead, own = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "lead", "own"))
                first = starts + lead
                last, shift = np.minimum(last, first + own), start - first
            last = np.maximum(first, last)
            for at in range(0, len(whole), BATCH):
                n = min(BATCH, len(whole) - at - width + 1)
                if n < 1:
                    break
                lead = 1 if at and space == "color" else 0
                codes = CODES[whole[at - lead : at + n + width - 1]]
                if space == "color":
                    there = slice(np.searchsorted(starts, at), np.searchsorted(starts, at + len(codes) - lead))
                    codes = color_codes(codes, at=starts[there] - at + lead)[lead:]
                if turned:
                    codes = np.where(codes & 4, codes, codes ^ 3)
                keys, good = _keys(codes, places, n, repeat_masker)
                some = slice(np.searchsorted(last, at, "right"), np.searchsorted(first, at + n))
                low, high = np.clip(first[some] - at, 0, n), np.clip(last[some] - at, 0, n)
                edge = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
                good &= np.cumsum(edge[:n]) > 0
                if sought is None:
                    pos = np.nonzero(good)[0]
                else:
                    pos = sought.value.among(keys)
                    pos = pos[good[pos]]
                if not len(pos):
                    continue
                each = np.searchsorted(pos, high) - np.searchsorted(pos, low)
                place = pos + np.repeat(shift[some] + at, each)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(contigs[some], each)), pa.array(place.astype(np.int32)), pa.array(keys[pos])], names=["contig", "pos", "key"])

    return cut


#: Code of each byte of a colour read; '.' and anything else is 4.
DIGITS = np.full(256, 4, np.uint8)
DIGITS[list(b"0123")] = range(4)


def read_keys(reads: DataFrame, mask: Mask, offsets: Sequence[int] | None = None, strands: str = "+-", space: str = "nt") -> DataFrame:
    """reads (read_id, end_no, seq) -> read_id, end_no, length, offset (from 0), strand, key.

    The key of the reverse strand is that of the window's reverse complement. ``offsets``: which windows; all if None.

    With ``space`` "color", ``seq`` is an adaptor's base and colours. The first colour hangs on the adaptor and is left out, so offset 0 is the second
    one; ``length`` counts all colours, which are as many as the read's bases. A reverse key is that of the window's colours turned round.
    """
    width, places = mask.width, mask.places
    turned = [width - 1 - p for p in places]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for read_id, end_no, seq in zip(b.column("read_id").to_pylist(), b.column("end_no").to_pylist(), b.column("seq").cast(pa.large_binary()).to_pylist()):
                text = np.frombuffer(seq or b"", np.uint8)
                codes, length = (CODES[text], len(text)) if space == "nt" else (DIGITS[text[2:]], max(len(text) - 1, 0))
                n = len(codes) - width + 1
                if n < 1:
                    continue
                other = np.where(codes & 4, codes, 3 - (codes & 3)) if space == "nt" else codes
                for strand, (c, at) in (("+", (codes, places)), ("-", (other, turned))):
                    if strand in strands:
                        keys, good = _keys(c, at, n, False)
                        if offsets is not None:
                            good &= np.isin(np.arange(n), offsets)
                        where = np.nonzero(good)[0]
                        out.append((np.full(len(where), read_id), np.full(len(where), end_no), np.full(len(where), length), where, np.full(len(where), strand), keys[where]))
            if out:
                columns = [np.concatenate(x) for x in zip(*out)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c.tolist() if k == pa.string() else c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=["read_id", "end_no", "length", "offset", "strand", "key"])

    schema = "read_id long, end_no int, length int, offset int, strand string, key long"
    return reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("end_no").cast("int").alias("end_no"), "seq").mapInArrow(cut, schema)


def key_text(key: Column, size: int) -> Column:
    """A key's bases, lower case."""
    return F.translate(F.lpad(F.conv(key.cast("string"), 10, 4), size, "0"), "0123", "acgt")


def bin_of(key: Column, mask: Mask) -> Column:
    """The number that the first ``depth`` bases of a key make, from 0."""
    return F.shiftrightunsigned(key, 2 * (mask.size - mask.depth)).cast("int")


def in_region(index: DataFrame, mask: Mask, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Windows that lie wholly in the inclusive region from (contig, position) to (contig, position)."""
    first = F.struct(F.col("contig"), F.col("pos"))
    last = F.struct(F.col("contig"), F.col("pos") + (mask.width - 1))
    at = lambda p: F.struct(F.lit(p[0]).cast("long"), F.lit(p[1]).cast("int"))
    return index.where((first >= at(start)) & (last <= at(end)))


#: Places are told apart by bins of 2**EXON_BIN bases when they are joined with ranges.
EXON_BIN = 12


def in_exons(index: DataFrame, mask: Mask, exons: DataFrame) -> DataFrame:
    """Windows that lie wholly inside one of ``exons`` (contig, start, end; inclusive).

    An exon stands in each bin of places that it touches, so windows meet only the exons near them, and a contig's many don't share one key.
    """
    bin_ = lambda c: F.shiftright(c.cast("long"), EXON_BIN)
    e = exons.where("end >= start").select(F.col("contig").cast("long").alias("contig"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    e = e.withColumn("_bin", F.explode(F.sequence(bin_(F.col("_start")), bin_(F.col("_end")))))
    w = index.withColumn("_bin", bin_(F.col("pos")))
    inside = (w["contig"] == e["contig"]) & (w["_bin"] == e["_bin"]) & (w["pos"] >= e["_start"]) & (w["pos"] + (mask.width - 1) <= e["_end"])
    return w.join(e, inside, "left_semi").drop("_bin")


def cut_exons(reference: DataFrame, mask: Mask, exons: DataFrame) -> DataFrame:
    """reference (contig, seq) -> its parts inside ``exons`` (contig, start, end; inclusive), as ``cut_contigs`` leaves chunks: their seeds are the windows that lie
    wholly inside an exon, each once where exons overlap. So what lies outside is never cut, and no seed meets an exon in a join.
    """
    from pyspark.sql import Window

    width = mask.width
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    first = F.greatest(start, F.lit(1).cast("long"))
    told = F.max("_to").over(Window.partitionBy("contig").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1))
    ranges = exons.select(F.col("contig").cast("long").alias("contig"), first.alias("_from"), (end - (width - 1)).alias("_to")).where("_to >= _from")
    ranges = ranges.withColumn("_from", F.greatest("_from", F.coalesce(told + 1, F.col("_from")))).where("_to >= _from")
    listed = ranges.groupBy("contig").agg(F.collect_list(F.struct("_from", "_to")).alias("_ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for contig, seq, inside in zip(*(b.column(c).to_pylist() for c in ("contig", "seq", "_ranges"))):
                seq = seq or ""
                rows = [(contig, r["_from"], 0, min(r["_to"], len(seq)) - r["_from"] + 1, seq[r["_from"] - 1 : r["_to"] + width - 1]) for r in inside if r["_from"] <= len(seq)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["contig", "start", "lead", "own", "seq"])

    return reference.select(F.col("contig").cast("long").alias("contig"), "seq").join(listed, "contig").mapInArrow(cut, CUT)


def checked_exons(exons: DataFrame) -> DataFrame:
    """Rows of ``exons`` that break the order that an exon file must have: inside out, or not after the one before on its contig."""
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy("contig").orderBy("start", "end"))
    return exons.withColumn("before", before).where((F.col("start") > F.col("end")) | (F.col("before") >= F.col("start")))


def key_frequency(index: DataFrame) -> DataFrame:
    """key, n: how often each key occurs; made once with the index, and read before any join with it."""
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def clamped(header: tuple[int, int], start: tuple[int, int], end: tuple[int, int], last_length: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """A region held to a reference whose first and last contigs are ``header`` and whose last contig has ``last_length`` bases: zeros stand for its ends."""
    first, last = header
    low = max(start, (first, 1)) if start[0] > 0 else (first, 1)
    high = min(end, (last, last_length)) if end[0] > 0 else (last, last_length)
    if low > high:
        raise ValueError("a region has to begin before it ends")
    return low, high


META = "index_no int, mask string, depth int, hash_width int, space string, start_contig long, start_pos long, end_contig long, end_pos long, buckets int, id string, cells int"
#: The least and the most buckets (files of a task and a bin), how often a key may occur in a segment before its seeds lie apart, and bases that a task is given at most.
LEAST_BUCKETS, MOST_BUCKETS, COMMON, TASK_BASES = 8, 64, 1 << 20, 1 << 26
OUTSIDE = -1


def _table(spark, path: str, meta) -> DataFrame:
    """The blocks of a stored index as a table that Spark knows to be in bins and in buckets by cell."""
    from .segments import BLOCKS

    name = f"seedloom_seeds_{meta['id']}"
    if not spark.catalog.tableExists(name):
        location = f"{path.rstrip('/')}/seeds/index_no={meta['index_no']}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({BLOCKS}, bin INT) USING parquet PARTITIONED BY (bin) CLUSTERED BY (key_cell) SORTED BY (key_cell) INTO {meta['buckets']} BUCKETS LOCATION '{location}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def stored_numbers(spark, path: str) -> list[int]:
    """Numbers of the indexes that are whole at ``path``."""
    try:
        meta = spark.read.schema(META).parquet(f"{path}/meta")
        return [r["index_no"] for r in meta.select("index_no").distinct().orderBy("index_no").collect()]
    except AnalysisException:  # no index was ever written there
        return []


Region = tuple[tuple[int, int], tuple[int, int]]
WHOLE: Region = ((0, 0), (0, 0))


def write_index(index: DataFrame, mask: Mask, path: str, index_no: int = 1, space: str = "nt", buckets: int | None = None, common: int = COMMON, region: Region = WHOLE) -> None:
    """The index as Parquet, in segments (see ``segments``): each task writes blocks of its own seeds, in bins by the first bases of keys and in buckets by cells of
    keys, with the layout beside them. No seed is shuffled.

    Reads are matched where seeds lie: a join on the cell shuffles the reads' keys alone, and reads only the bins that they ask for. Seeds of keys that occur more than
    ``common`` times in a segment lie outside the bins, dealt evenly, as they could make a bucket too large. There are as many files as tasks times buckets times bins.
    ``region`` is what the seeds were cut from, for ``compatible``.

    A number that is there is refused. The layout is written last, so an index whose writing was cut off isn't there, and its number can be written anew.
    """
    rows = index.select(F.col("contig").cast("long").alias("contig"), F.col("pos").cast("int").alias("pos"), F.col("key").cast("long").alias("key"))
    _write_segments(rows, lambda batches: batches, mask, path, index_no, space, buckets, common, region)


def _write_segments(rows: DataFrame, cut, mask: Mask, path: str, index_no: int, space: str, buckets: int | None = None, common: int = COMMON, region: Region = WHOLE) -> None:
    """What ``cut`` makes of ``rows``, batches of seeds, as an index; both are done by one task."""
    from .segments import BLOCKS, CELLS, segments

    spark = rows.sparkSession
    if index_no in stored_numbers(spark, path):
        raise FileExistsError(f"index {index_no} is at {path}")
    if buckets is None:
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, spark.sparkContext.defaultParallelism))
    blocks = rows.mapInArrow(lambda batches: segments(cut(batches), mask, common), f"{BLOCKS}, bin INT")
    location, table = f"{path.rstrip('/')}/seeds/index_no={index_no}", f"seedloom_write_{uuid.uuid4().hex}"
    # Blocks are compressed already; small groups of rows keep what a reader holds small.
    options = {"path": location, "compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 24)}
    blocks.write.mode("overwrite").partitionBy("bin").bucketBy(buckets, "key_cell").sortBy("key_cell").options(**options).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    meta = (index_no, mask.text, mask.depth, mask.hash_width, space, *region[0], *region[1], buckets, uuid.uuid4().hex, CELLS)
    spark.createDataFrame([meta], META).coalesce(1).write.mode("append").parquet(f"{path}/meta")


def _measured(reference: DataFrame | Texts):
    """first and last contig, length of the last, and an upper bound of bases: in all and in the largest partition."""
    rows, text = (reference.rows, "text") if isinstance(reference, Texts) else (reference, "seq")
    length = F.octet_length(text) if text == "text" else F.length(text)
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min("contig").alias("first"), F.max("contig").alias("last"), F.max_by(length, "contig").alias("length"), F.sum(length).alias("bases"))
    told = parts.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("length", "last").alias("length"), F.sum("bases").alias("total"), F.max("bases").alias("most")).first().asDict()
    if isinstance(reference, Texts) and told["last"] is not None:
        table = reference.table

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(turned_texts(b.column("text"), table)[1]))], names=["length"])

        last = rows.where(F.col("contig") == told["last"]).select("text").mapInArrow(counted, "length long")
        told["length"] = last.agg(F.max("length").alias("length")).first()["length"]
    return told


def build_index(reference: DataFrame | Texts, mask: Mask, path: str, index_no: int = 1, space: str = "nt", region: Region = WHOLE, repeat_masker: bool = False, **options) -> None:
    """Cut ``reference`` (contig, seq) into seeds, those of ``region`` (zeros stand for the reference's ends), and write them as an index.

    A task sorts what it writes, so a reference of partitions over TASK_BASES is dealt anew, by ranges of contigs: texts are shuffled then, as seeds are five times as many bytes.
    """
    told, cut_out = _measured(reference), region != WHOLE
    if told["first"] is not None:
        region = clamped((told["first"], told["last"]), *region, told["length"] or 0)
    chunked = "lead" in reference.columns
    if (told["most"] or 0) > TASK_BASES:
        parts, by = -(-told["total"] // TASK_BASES), ["contig", "start"] if chunked else ["contig"]
        reference = Texts(reference.rows.repartitionByRange(parts, *by), reference.table) if isinstance(reference, Texts) else reference.repartitionByRange(parts, *by)
    if cut_out and told["first"] is not None:
        write_index(in_region(seeds(reference, mask, repeat_masker, space=space), mask, *region), mask, path, index_no, space, region=region, **options)
        return
    cut = _cutter(mask, repeat_masker, None, space, chunked, table=_table_of(reference))
    _write_segments(_scanned(reference), cut, mask, path, index_no, space, region=region, **options)


def read_index(spark, path: str, index_no: int = 1):
    """(seeds with their bin, key frequencies with theirs, mask) of an index as ``write_index`` leaves it: ``segments.Segments``, to be used as DataFrames. Seeds outside
    the bins have bin OUTSIDE."""
    from .segments import CELLS, Segments

    meta = spark.read.schema(META).parquet(f"{path}/meta").where(F.col("index_no") == index_no).first()
    if meta is None:
        raise ValueError(f"no index {index_no} at {path}")
    if meta["cells"] != CELLS:
        raise ValueError(f"index {index_no} at {path} is of another layout: build it anew")
    mask = Mask(meta["mask"], meta["depth"], meta["hash_width"])
    kept = _table(spark, path, meta)
    return Segments(kept, mask, True), Segments(kept, mask, False), mask


def read_indexes(spark, path: str, numbers: Sequence[int] | None = None) -> list[tuple[DataFrame, DataFrame, Mask]]:
    """The indexes of these numbers (see ``bases.number_list``), or all that are there, in order. They have to be compatible."""
    there = stored_numbers(spark, path)
    wanted = there if numbers is None else list(numbers)
    if missing := sorted(set(wanted) - set(there)):
        raise ValueError(f"no index {missing} at {path}")
    if wanted and not compatible(spark.read.schema(META).parquet(f"{path}/meta").where(F.col("index_no").isin(wanted))):
        raise ValueError("indexes of different spaces or regions")
    return [read_index(spark, path, n) for n in wanted]


def compatible(meta: DataFrame) -> bool:
    """Whether indexes (index_no, space, start_contig, start_pos, end_contig, end_pos) cover the same region in the same space."""
    kinds = [k for k in ("space", "start_contig", "start_pos", "end_contig", "end_pos") if k in meta.columns]
    row = meta.agg(*[F.min(k).eqNullSafe(F.max(k)).alias(k) for k in kinds]).first()
    return all(row[k] for k in kinds)
