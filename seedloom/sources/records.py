"""Files of candidates and of alignments as lines: records whose first line tells how many lines follow, read by many tasks.

A record's first line has two fields, its name and the number of its ends; an end's line has at least three. So a task finds the first record of its
range of bytes by itself, and a record belongs to the task in whose range it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .fastq import BUFFER, SPLIT, Malformed, Range, _opened
from .sequences import read_alignment_lines, read_match_lines, with_number

SCHEMA = "file string, at long, line string"


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.buffer = options["path"], int(options.get("splitbytes", SPLIT)), int(options.get("bufferbytes", BUFFER))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = _opened(self.path)
        info = store.get_file_info(root)
        every = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in every if x.is_file and not x.base_name.startswith(("_", ".")))
        return [Range(path, at, min(at + self.split, size), size) for path, size in files for at in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def lines(self, source, at: int) -> Iterator[tuple[int, bytes]]:
        """Lines from the first that begins at ``at`` or behind, with where they begin."""
        source.seek(begin := max(at - 1, 0))
        data, skip = b"", at > 0  # the rest of the line that the byte before belongs to
        while True:
            more = source.read(self.buffer)
            data += more
            start = 0
            while (end := data.find(b"\n", start)) >= 0:
                if not skip:
                    yield begin + start, data[start:end]
                skip, start = False, end + 1
            data, begin = data[start:], begin + start
            if not more:
                if data and not skip:
                    yield begin, data
                return

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        store, _ = _opened(part.path if "://" in part.path else self.path)
        rows, now, left = [], None, 0
        with store.open_input_file(part.path) as source:
            for at, line in self.lines(source, part.start):
                if left:
                    now[2].append(line)
                    left -= 1
                elif not line.strip():
                    continue
                elif at >= part.end:
                    break
                elif line.count(b"\t") == 1 and line.split(b"\t")[1].strip().isdigit():
                    now, left = (part.path, at, [line]), int(line.split(b"\t")[1])
                    rows.append(now)
                elif now is None and part.start:
                    continue  # ends of a record that began before
                else:
                    raise Malformed(f"{part.path} at byte {at}: a record begins with its name and the number of its ends")
        if left:
            raise Malformed(f"{part.path} at byte {now[1]}: a record ends before its last end")
        for k in range(0, len(rows), 10_000):
            some = rows[k : k + 10_000]
            text = [b"\n".join(r[2]).decode("utf-8", "replace") for r in some]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.int64()), pa.array(text, pa.string())], names=["file", "at", "line"])


class RecordSource(DataSource):
    """``spark.read.format("line_records").load(path)``; options: splitBytes, bufferBytes."""

    @classmethod
    def name(cls) -> str:
        return "line_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def read_records(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """read_id (from 1, in the order of files and of records in them), line: the records of the files at ``path``."""
    spark.dataSource.register(RecordSource)
    rows = spark.read.format("line_records").option("splitBytes", split_bytes).load(path)
    return with_number(rows, ["file", "at"]).select(F.col("n").alias("read_id"), "line")


def write_records(lines: DataFrame, path: str) -> None:
    """Records (read_id, line) as files, in the order of their ids over parts and in them."""
    lines.repartitionByRange("read_id").sortWithinPartitions("read_id").select("line").write.text(path)


def read_matches(spark: SparkSession, path: str, split_bytes: int = SPLIT, offsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates, ends) of files as ``write_records`` leaves those of ``match_lines``."""
    return read_match_lines(read_records(spark, path, split_bytes), offsets)


def read_alignments(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(alignments, ends) of files as ``write_records`` leaves those of ``alignment_lines``."""
    return read_alignment_lines(read_records(spark, path, split_bytes))


def matches_to_fastq(spark: SparkSession, path: str, out: str) -> None:
    """The reads of files of candidates as FASTQ, a record for each end, in the order of the files."""
    _, ends = read_matches(spark, path)
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    ends.repartitionByRange("read_id", "end_no").sortWithinPartitions("read_id", "end_no").select(record).write.text(out)


def alignments_to_sam(spark: SparkSession, path: str, contigs: DataFrame, out: str, **options) -> None:
    """Files of alignments as sorted SAM; contigs: contig, name, length."""
    from ..functions.sam import records, write_sam

    alignments, ends = read_alignments(spark, path)
    write_sam(records(alignments, ends, contigs, **options), contigs, out)
