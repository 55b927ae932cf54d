"""Streams against one batch of the same reads; files of lines cut between tasks."""

import random

import pytest
from pyspark.sql import functions as F

from seedloom.operators import select
from seedloom.operators.match import MatchOptions
from seedloom.operators.seeds import Mask
from seedloom.plans.workflow import paired_alignments, scored_alignments
from seedloom.sources import fastq, records, sequences
from seedloom.streaming import alignment

TURN = str.maketrans("acgt", "tgca")
READS = "read_id long, end_no int, seq string"


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_a_stream_of_any_files_is_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(select, "LEAST_DISTANCES", 20)
    rng = random.Random(1)
    ref = "".join(rng.choices("acgt", k=3000))
    rows = []
    for i in range(40):
        at = rng.randint(0, 2700)
        first, second = ref[at : at + 30], ref[at + 100 + i % 5 : at + 130 + i % 5]
        if i % 3 == 0:
            first, second = (x.translate(TURN)[::-1] for x in (second, first))
        rows += [(i, 1, first), (i, 2, second if i % 10 else "acgt" * 8)]
    every = spark.createDataFrame(rows, READS)
    reference = spark.createDataFrame([(1, ref)], "contig long, seq string")
    mask, options = Mask("111111111111"), dict(options=MatchOptions(), constrained=False, offset=5)
    scored = scored_alignments(every, reference, mask, **options)
    columns, chosen = ["read_id", "end_no", "contig", "position", "strand", "score", "mapq"], ["read_id", "end_no", "contig", "position", "strand", "score", "mapq", "proper"]
    want, size = rows_of(scored, columns), select.insert_size(select.distances(scored))
    assert size.deviation and len(want) > 60
    for files in (1, 3):
        out, source = str(tmp_path / f"out{files}"), str(tmp_path / f"reads{files}")
        for k in range(files):
            part = every.where(F.col("read_id") % files == k).coalesce(1)
            part.write.mode("append").parquet(source)
            if k < files - 1 or files == 1:  # a stop and a start between files
                stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(source)
                alignment.align_stream(stream, reference, mask, out, str(tmp_path / f"state{files}"), **options).awaitTermination()
        stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(source)
        alignment.align_stream(stream, reference, mask, out, str(tmp_path / f"state{files}"), **options).awaitTermination()
        assert rows_of(spark.read.parquet(f"{out}/scored"), columns) == want
        told = alignment.stream_insert_size(spark, out)
        assert told.mean == pytest.approx(size.mean) and told.deviation == pytest.approx(size.deviation)
        assert rows_of(alignment.paired_anew(spark, out, every), chosen) == rows_of(paired_alignments(scored, every, insert=size), chosen) != []


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    d = spark.createDataFrame([(1, 10), (2, 20)], "read_id long, distance long")
    for number in (0, 1, 1):
        alignment.moments(d).write.mode("overwrite").parquet(f"{tmp_path}/distances/batch={number}")
    row = spark.read.parquet(f"{tmp_path}/distances").agg(F.sum("n"), F.sum("total"), F.sum("squares")).first()
    assert tuple(map(int, row)) == (4, 60, 1000)
    assert alignment.stream_insert_size(spark, str(tmp_path)) == alignment.stream_insert_size(spark, str(tmp_path / "none")) == select.InsertSize()


ALIGNED = "read_id long, end_no int, contig long, position long, strand string, score int, mapq int, aln_read string, aln_ref string"


def test_files_of_lines_come_back(spark, tmp_path):
    cals = [(i, 1, 7 + k, 100 * i + k, "+-"[k % 2], "0110", [1, 5 + k]) for i in range(1, 30) for k in range(i % 4)]
    cals = spark.createDataFrame(cals, "read_id long, end_no int, contig long, position int, strand string, mask string, offsets array<int>")
    ends = [(i, f"r{i:03}", e, "ACGT", "II@I", -1 if i == 3 else e) for i in range(1, 30) for e in range(1, 1 + i % 3)]
    ends = spark.createDataFrame(ends, "read_id long, name string, end_no int, seq string, qual string, max_reached int")
    for offsets in (False, True):
        path = str(tmp_path / f"m{offsets}")
        records.write_records(sequences.match_lines(cals, ends, offsets), path)
        last = "offsets" if offsets else "mask"
        kept = cals.join(ends.select("read_id", "end_no", "name"), ["read_id", "end_no"]).select("name", "end_no", "contig", "position", "strand", last)
        for split in (1, 7, 64, 1 << 20):
            back, state = records.read_matches(spark, path, split, offsets)
            assert rows_of(state, ["name", "end_no", "seq", "qual", "max_reached"]) == rows_of(ends, ["name", "end_no", "seq", "qual", "max_reached"])
            named = back.join(state.select("read_id", "end_no", "name"), ["read_id", "end_no"])
            assert rows_of(named, kept.columns) == rows_of(kept, kept.columns) != []
    records.matches_to_fastq(spark, str(tmp_path / "mFalse"), str(tmp_path / "fq"))
    assert rows_of(sequences.read_fastq(spark, str(tmp_path / "fq")), ["name", "seq", "qual"]) == rows_of(ends, ["name", "seq", "qual"])
    found = spark.createDataFrame([(i, 1, 7, i, "+", 10, 3, "ACGT", "ACGT") for i in range(1, 9)], ALIGNED)
    own = spark.createDataFrame([(i, f"r{i}", 1, "ACGT", "IIII") for i in range(1, 10)], "read_id long, name string, end_no int, seq string, qual string")
    records.write_records(sequences.alignment_lines(found, own), str(tmp_path / "a"))
    back, _ = records.read_alignments(spark, str(tmp_path / "a"), 10)
    assert rows_of(back, found.columns) == rows_of(found, found.columns)
    contigs = spark.createDataFrame([(7, "chr", 60)], "contig long, name string, length int")
    records.alignments_to_sam(spark, str(tmp_path / "a"), contigs, str(tmp_path / "sam"))
    lines = [x for p in sorted((tmp_path / "sam").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x.split("\t")[0] for x in lines if not x.startswith("@")] == [f"r{i}" for i in range(1, 10)]


def test_what_isn_t_a_record_of_lines(tmp_path):
    for text in ("no head\n", "r\t2\na\tb\tc\n", "r\t1\na\tb\tc\nx\ty\tz\n"):
        (tmp_path / "x").write_text(text)
        reader = records.RecordReader({"path": str(tmp_path / "x"), "bufferbytes": "3"})
        with pytest.raises(fastq.Malformed):
            list(reader.read(fastq.Range(str(tmp_path / "x"), 0, len(text), len(text))))
