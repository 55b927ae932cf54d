"""FASTA files in chunks, one file cut between tasks.

A range owns the bases and the headers whose bytes lie in it, and a task reads many ranges if they are small. What lies around a chunk, bases before it and behind it, is read from the
file, so that what begins at a chunk's base is told by the chunk alone. Which contig a chunk belongs to, and where in it, follows from counts of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bases import normalised
from ..storage import stored
from .fastq import SPLIT, Malformed, Range, _opened

#: Bases of a chunk, and bytes that are looked at around a range at first.
CHUNK, MARGIN = 1 << 20, 1 << 16
SCHEMA = "file string, range long, at long, first boolean, name string, lead int, own int, seq string, begun long, upto long"
BLANK = b" \t\r\n\x0b\x0c"


@dataclass
class Ranges(InputPartition):
    """What a task reads, one range after another."""

    own: list[Range]


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.margin = options["path"], int(options.get("splitbytes", SPLIT)), int(options.get("marginbytes", MARGIN))
        self.tasks = int(options.get("tasks", 0))
        self.size, self.before, self.after = int(options.get("chunk", CHUNK)), int(options.get("before", 1)), int(options.get("after", 0))

    def partitions(self) -> list[Ranges]:
        """Ranges in order, dealt to ``tasks`` tasks (to more if these would read over SPLIT bytes each; to one each without ``tasks``)."""
        ranges = self.ranges()
        most = min(SPLIT, sum(r.end - r.start for r in ranges) // self.tasks) if self.tasks else 0
        out, held = [], 0
        for r in ranges:
            if not out or held + r.end - r.start > most:
                out.append(Ranges([]))
                held = 0
            out[-1].own.append(r)
            held += r.end - r.start
        return out

    def ranges(self) -> list[Range]:
        from pyarrow import fs

        store, root = _opened(self.path)
        info = store.get_file_info(root)
        every = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in every if x.is_file and not x.base_name.startswith(("_", ".")))
        return [Range(path, at, min(at + self.split, size), size) for path, size in files for at in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, part: Range | Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        rows: list[tuple] = []
        for path, ranges in groupby(part.own if isinstance(part, Ranges) else [part], lambda r: r.path):
            if path:
                with store.open_input_file(path) as source:
                    for r in ranges:
                        for row in self.read_range(source, r):
                            rows.append(row)
                            if len(rows) * max(self.size, 1 << 10) >= 1 << 24:
                                yield _batch(rows)
                                rows = []
        yield _batch(rows)

    def read_range(self, source, part: Range) -> Iterator[tuple]:
        if part.start == part.end:
            return
        source.seek(part.start)
        own = source.read(part.end - part.start)
        head, before = self.behind(source, part.start)
        rest, after = self.ahead(source, part, own, head)
        source.seek(max(part.start - 1, 0))
        yield from self.chunks(part, own, head, before, rest, after, source.read(1) == b"\n")

    def behind(self, source, start: int) -> tuple[bool, bytes]:
        """Whether the range begins inside a header's line, and up to ``before`` bases of the same contig before it."""
        margin = self.margin
        while True:
            low = max(0, start - margin)
            source.seek(low)
            lines = source.read(start - low).split(b"\n")
            if len(lines) > 1 or low == 0:
                if lines[-1].startswith(b">"):
                    return True, b""
                bases, k = b"", len(lines) - 1
                while k >= (0 if low == 0 else 1) and len(bases) < self.before and not lines[k].startswith(b">"):
                    bases, k = lines[k].translate(None, BLANK) + bases, k - 1
                # The first line that was read may be the rest of a header's.
                if len(bases) >= self.before or low == 0 or lines[max(k, 0)].startswith(b">"):
                    return False, bases[-self.before :] if self.before else b""
            margin *= 4

    def ahead(self, source, part: Range, own: bytes, head: bool) -> tuple[bytes, bytes]:
        """What the last header's line lacks in the range, and up to ``after`` bases of the same contig behind it."""
        source.seek(part.end)
        line = own[own.rfind(b"\n") + 1 :]
        in_header = line.startswith(b">") if b"\n" in own or not head else True
        begins = own.endswith(b"\n")
        data, margin = b"", self.margin
        while True:
            more = source.read(margin)
            data += more
            rest, text = b"", data
            if in_header and not begins:
                cut = data.find(b"\n")
                if cut < 0 and more:
                    continue
                rest, text = (data[:cut], data[cut + 1 :]) if cut >= 0 else (data, b"")
            at_line = begins or in_header
            stop = 0 if at_line and text.startswith(b">") else text.find(b"\n>")
            bases = (text if stop < 0 else text[:stop]).translate(None, BLANK)
            if len(bases) >= self.after or stop >= 0 or not more:
                return rest, bases[: self.after]
            margin *= 4

    def chunks(self, part: Range, own: bytes, head: bool, before: bytes, rest: bytes, after: bytes, at_line: bool) -> Iterator[tuple]:
        begins_line = part.start == 0 or (not head and at_line)
        pieces, at = [], 0  # (where, name or None, bases)
        if head:
            at = own.find(b"\n") + 1 or len(own)
        if not (begins_line and own.startswith(b">", at)) or head:
            stop = at if own.startswith(b">", at) and (head or begins_line) else own.find(b"\n>", at)
            stop = len(own) if stop < 0 else stop
            bases = own[at:stop].translate(None, BLANK)
            if part.start == 0 and bases:
                raise Malformed(f"{part.path} begins with no header")
            pieces.append((part.start + at, None, bases))
            at = own.find(b">", stop)
        while 0 <= at < len(own):
            end = own.find(b"\n", at)
            header = own[at + 1 : end] if end >= 0 else own[at + 1 :] + rest
            end = len(own) if end < 0 else end
            stop = own.find(b"\n>", end)
            stop = len(own) if stop < 0 else stop
            pieces.append((part.start + at, (header.split(None, 1) or [b""])[0], own[end:stop].translate(None, BLANK)))
            at = own.find(b">", stop) if stop < len(own) else -1
        begun = 0  # contigs of the range
        for i, (where, name, bases) in enumerate(pieces):
            lead, behind = (before if name is None else b""), (after if i == len(pieces) - 1 else b"")
            text, n, first = lead + bases + behind, len(bases), name is not None
            begun += first
            for k in range(0, max(n, 1), self.size):
                own_n, low = min(self.size, n - k), max(0, len(lead) + k - self.before)
                seq = text[low : len(lead) + k + own_n + self.after]
                yield part.path, part.start, where + k, first and k == 0, name.decode("utf-8", "replace") if first and k == 0 else None, len(lead) + k - low, own_n, seq.decode("latin-1"), begun, k


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class FastaSource(DataSource):
    """``spark.read.format("fasta_chunks").load(path)``; options: splitBytes, marginBytes, tasks, chunk, before, after (bases).

    ``begun`` is how many contigs of the range have begun with a row, ``upto`` how many bases of its contig the range has before it."""

    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def read_chunks(spark: SparkSession, path: str, after: int, size: int = CHUNK, before: int = 1, split_bytes: int = SPLIT, margin_bytes: int = MARGIN) -> tuple[DataFrame, DataFrame]:
    """(chunks, names) of the FASTA files at ``path``: contig (from 1, in file order), start, lead, own, seq as ``cut_contigs`` has them; and contig, name, length.

    A file is cut into ranges of ``split_bytes``, and small ranges are dealt to four tasks a core. Of each range the number of contigs that begin in it and of bases behind the last of them are gathered: they tell
    the number and the place of what the next ranges hold. U counts as T, ambiguity as N.
    """
    spark.dataSource.register(FastaSource)
    options = dict(splitBytes=split_bytes, marginBytes=margin_bytes, chunk=size, before=before, after=after, tasks=4 * spark.sparkContext.defaultParallelism)
    raw = stored(spark.read.format("fasta_chunks").options(**options).load(path), "fasta")
    end = F.max_by(F.struct("begun", (F.col("upto") + F.col("own")).alias("tail")), F.struct("begun", "at"))
    ranges = raw.groupBy("file", "range").agg(end.alias("end")).select("file", "range", "end.*")
    # A row a range from here on.
    along = Window.orderBy("file", "range")
    ranges = ranges.withColumn("_upto_no", F.sum("begun").over(along))
    # A contig's bases up to a range's end, which the next range goes on from.
    ranges = ranges.withColumn("_held", F.sum("tail").over(Window.partitionBy("_upto_no").orderBy("file", "range")))
    starts = ranges.select("file", "range", (F.col("_upto_no") - F.col("begun")).alias("_base"), F.coalesce(F.lag("_held").over(along), F.lit(0)).alias("_carried"))
    placed = raw.join(F.broadcast(starts), ["file", "range"])
    contig = (F.col("_base") + F.col("begun")).cast("long").alias("contig")
    start = (F.col("upto") + F.when(F.col("begun") == 0, F.col("_carried")).otherwise(0) + 1).cast("long").alias("start")
    chunks = placed.select(contig, start, "lead", "own", normalised(F.col("seq")).alias("seq"), "name", "first")
    names = chunks.groupBy("contig").agg(F.max("name").alias("name"), F.sum("own").cast("long").alias("length"))
    return chunks.where((F.col("own") > 0) | F.col("first")).drop("name", "first"), names
