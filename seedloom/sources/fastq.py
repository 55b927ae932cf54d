"""FASTQ files as a PySpark data source that cuts one file between tasks.

A task owns the records that begin within its range of bytes. It finds the first of them by itself: ``@`` also begins lines of qualities,
and sequences and qualities may be cut over lines, so it parses from each line with ``@`` in a margin before its range. What isn't a record
soon fails to parse, or falls in step with those that are; where the parses that began in the margin's first half don't agree on the first record of the range,
the margin grows, at last to the file's beginning, where the only record is the first. Files are opened
through pyarrow's file systems.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, at long, name string, seq string, qual string"
#: Bytes of a task's range, of its first margin, and of a read from a file.
SPLIT, MARGIN, BUFFER = 64 << 20, 64 << 10, 4 << 20
#: Letters of a line of sequence: bases and ambiguity, colours, unknown ones and gaps.
LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-*")
BLANK = b" \t\r\x0b\x0c"


class Malformed(ValueError):
    pass


class Short(Exception):
    """What was read ends before the record does."""


def _line(data: bytes, at: int, ended: bool) -> tuple[bytes, int]:
    """The line at ``at`` without blanks at its ends, and where the next begins."""
    end = data.find(b"\n", at)
    if end < 0:
        if not ended:
            raise Short
        end = len(data)
    return data[at:end].strip(BLANK), end + 1


def record(data: bytes, at: int, ended: bool, fewer: int = 0) -> tuple[bytes, bytes, bytes, int]:
    """Name (up to white space), sequence and qualities of the record at ``at``, and where the next begins.

    Qualities are ``fewer`` than the sequence's letters. They end with a line. ``ended``: the file ends with ``data``.
    """
    head, at = _line(data, at, ended)
    if not head.startswith(b"@"):
        raise Malformed("a record begins with @")
    parts = []
    while True:
        if at >= len(data):
            raise Malformed("a record ends before its qualities") if ended else Short
        line, at = _line(data, at, ended)
        if line.startswith(b"+"):
            break
        if not LETTERS.issuperset(line):
            raise Malformed("a sequence has other letters")
        parts.append(line)
    if len(line) > 1 and line[1:] != head[1:]:
        raise Malformed("the name after + is another")
    seq = b"".join(parts)
    name = head[1:].split(None, 1)[0] if len(head) > 1 and head[1:].split() else b""
    parts, n, wanted = [], 0, max(len(seq) - fewer, 0)
    while n < wanted:
        if at >= len(data):
            if not ended:
                raise Short
            break
        line, at = _line(data, at, ended)
        parts.append(line)
        n += len(line)
    if n != wanted:
        raise Malformed("qualities are of another length than the sequence")
    return name, seq, b"".join(parts), at


def passed(data: bytes, at: int, ended: bool) -> int:
    """``at``, or where the next line with something in it begins."""
    while at < len(data):
        line, after = _line(data, at, ended)
        if line:
            break
        at = after
    return at


def first_record(data: bytes, own: int, whole: bool, ended: bool, fewer: int = 0) -> int | None:
    """Where the first record at ``own`` or behind begins, by parses from lines with ``@`` in the first half of what lies before; None if they don't agree.

    ``whole``: ``data`` begins with the file, so that its first line with ``@`` begins a record. Raises ``Short`` where more is needed behind.
    """
    if whole:
        starts = [0 if data.startswith(b"@") else data.find(b"\n@") + 1]
        if not data.startswith(b"@", starts[0]):
            if not ended:
                raise Short
            return len(data)
    else:
        middle, starts, at = own // 2, [], data.find(b"\n@")
        while 0 <= at < middle:
            starts.append(at + 1)
            at = data.find(b"\n@", at + 1)
    known: dict[int, int | None] = {}  # the first record of the range, by where a parse stood
    for start in reversed(starts):
        at, way = start, []
        while at < own and at not in known:
            way.append(at)
            try:
                at = passed(data, record(data, at, ended, fewer)[3], ended)
            except Malformed:
                if whole:
                    raise
                at = -1
                break
            if at >= len(data) and not ended:
                raise Short
        found = None if at < 0 else known[at] if at in known else at
        known.update(dict.fromkeys([start, *way], found))
    ends = {e for s in starts if (e := known[s]) is not None}
    return ends.pop() if len(ends) == 1 else None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split, self.margin = int(options.get("splitbytes", SPLIT)), int(options.get("marginbytes", MARGIN))
        self.fewer = 1 if options.get("space", "nt") == "color" else 0

    def partitions(self) -> list[Range]:
        """Ranges of ``splitBytes``; a compressed file is one."""
        from pyarrow import fs

        store, root = _opened(self.path)
        info = store.get_file_info(root)
        every = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in every if x.is_file and not x.base_name.startswith(("_", ".")))
        out = []
        for path, size in files:
            step = max(size, 1) if path.endswith(".gz") else self.split
            out += [Range(path, at, min(at + step, size), size) for at in range(0, size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == part.start:
            return
        store, _ = _opened(self.path)
        if part.path.endswith(".gz"):
            with store.open_input_stream(part.path, compression=None) as raw:
                yield from self.records(gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 16)), part, None)
        else:
            with store.open_input_file(part.path) as source:
                source.seek(begin := self.border(source, part))
                yield from self.records(source, Range(part.path, begin, part.end, part.size), begin)

    def border(self, source, part: Range) -> int:
        """Where the first record of the range begins; the end if none does."""
        margin, behind = self.margin, self.margin
        while True:
            low = max(0, part.start - margin)
            source.seek(low)
            data = source.read(part.start - low + behind)
            ended = low + len(data) >= part.size
            try:
                found = first_record(data, part.start - low, low == 0, ended, self.fewer)
            except Short:
                behind *= 4
                continue
            except Malformed as error:
                raise Malformed(f"{part.path} before byte {part.start}: {error}") from None
            if found is not None:
                return min(low + found, part.size)
            margin *= 4

    def records(self, source, part: Range, start: int | None) -> Iterator[pa.RecordBatch]:
        """Records that begin before the range's end, from ``start`` on: a border, or None for a compressed file, which is read whole."""
        base, data, at, ended = start or 0, b"", 0, False
        rows: list[tuple] = []
        if not start:  # what lies before the first record is passed over
            while not ended and not (data.startswith(b"@") or b"\n@" in data):
                more = source.read(BUFFER)
                data, ended = data + more, not more
            at = 0 if data.startswith(b"@") else data.find(b"\n@") + 1
            if not data.startswith(b"@", at):
                return
        while start is None or base + at < part.end:
            try:
                at = passed(data, at, ended)
                if at >= len(data):
                    if ended:
                        break
                    raise Short
                if start is not None and base + at >= part.end:
                    break
                name, seq, qual, after = record(data, at, ended, self.fewer)
            except Short:
                more = source.read(max(BUFFER, len(data) - at))  # twice as much for a record longer than that
                data, base, at, ended = data[at:] + more, base + at, 0, not more
                continue
            except Malformed as error:
                raise Malformed(f"{part.path} at byte {base + at}: {error}") from None
            rows.append((part.path, base + at, name.decode("utf-8", "replace"), seq.decode("ascii"), qual.decode("latin-1")))
            at = after
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "at", "name", "seq", "qual"])


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``; options: splitBytes, marginBytes, space (``color``: an adaptor's base has no quality)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT, space: str = "nt") -> DataFrame:
    """file, at (the byte at which a record begins: file order), name (up to white space), seq, qual of the FASTQ files at ``path``, a file or a folder.

    Sequences and qualities may be cut over lines; with ``space`` "color" there is one quality fewer than letters. Files are cut into ranges of about ``split_bytes``, one to a task; a ``.gz`` file is one task's. What isn't
    a record ends the query with an error that names its place. An empty file has no rows.
    """
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitBytes", split_bytes).option("space", space).load(path)
