"""Colour errors, qualities, tags and the sorted sink, each against a plain account."""

import random

import pytest
from pyspark.sql import functions as F

from seedloom.functions import sam

ALIGNED = "read_id long, end_no int, contig long, position long, strand string, score int, mapq int, aln_read string, aln_ref string"
ENDS = "read_id long, name string, end_no int, seq string, qual string"


def colors_of(bases, before="A"):
    return "".join(str("ACGT".index(a) ^ "ACGT".index(b)) for a, b in zip(before + bases, bases))


def test_color_errors():
    assert sam.color_errors("ACGT", "ACGT", "A" + colors_of("ACGT")) == "----"
    wrong = "A" + colors_of("ACGT")[:2] + "0" + colors_of("ACGT")[3:]
    assert sam.color_errors("ACGT", "ACGT", wrong) == "--0-"
    assert sam.color_errors("AC-GT", "ACTGT", wrong) == "---0-"
    assert sam.color_errors("ACGT", "AC-T", wrong) == "----"  # an inserted base has none
    assert sam.color_errors("ACGT", "ACGT", "T" + "." + colors_of("ACGT")[1:]) == "4---"


def test_base_qualities_by_mode():
    q = lambda *n: "".join(chr(33 + x) for x in n)
    assert sam.color_base_qualities("ACGT", "----", q(10, 20, 30, 40), 0) == q(40, 60, 63, 40)
    assert sam.color_base_qualities("ACGT", "-0--", q(10, 25, 30, 40), 0) == q(1, 5, 63, 40)
    assert sam.color_base_qualities("ACGT", "-00-", q(30, 25, 30, 40), 0) == q(5, 1, 10, 40)
    assert sam.color_base_qualities("AC-GT", "-0---", q(30, 25, 30, 40), 0) == q(5, 5, 63, 40)
    assert sam.color_base_qualities("ACGT", "-0--", q(10, 25, 30, 0), 1) == q(10, 25, 1, 1)
    assert sam.color_base_qualities("ACGT", "-0--", q(10, 25, 30, 0), 2) == q(25, 30, 30, 1)
    assert sam.color_base_qualities("ACGT", "-0--", q(10, 25, 30, 40), 3) == q(1, 1, 63, 40)
    assert sam.color_read_qualities(q(10, 10, 20, 0, 30)) == q(10, 10, 13, 0, 0) and sam.color_read_qualities("") == ""


@pytest.mark.parametrize("mode", range(4))
def test_quality_column_is_the_function(spark, mode):
    rng = random.Random(mode)
    rows = [(rng.randint(0, 63), rng.randint(0, 63), rng.random() < 0.5, rng.random() < 0.5) for _ in range(100)]
    got = spark.createDataFrame(rows, "a int, b int, x boolean, y boolean").select(sam.base_quality(*[F.col(c) for c in "abxy"], mode)).collect()
    want = [ord(sam.color_base_qualities("ACG", f"{'0' if x else '-'}{'0' if y else '-'}-", chr(33 + a) + chr(33 + b) + "I", mode)[0]) - 33 for a, b, x, y in rows]
    assert [g[0] for g in got] == want


def fields(df):
    return [r["line"].split("\t") for r in df.orderBy("read_id", "end_no", "hit").collect()]


def test_alignments_of_the_reverse_strand_are_told_forward(spark):
    """In read direction the read lacks a base of the reference after its first two."""
    a = spark.createDataFrame([(1, 1, 7, 5, "-", 100, 9, "AC-GTT", "ACAGTA")], ALIGNED)
    ends = spark.createDataFrame([(1, "r", 1, "ACGTT", "ABCDE")], ENDS)
    (f,) = fields(sam.records(a, ends, spark.createDataFrame([(7, "chr")], "contig long, name string")))
    assert f[:11] == ["r", "16", "chr", "5", "9", "3M1D2M", "*", "0", "0", "AACGT", "EDCBA"]
    assert f[11:] == ["PG:Z:seedloom", "AS:i:100", "NM:i:2", "NH:i:1", "IH:i:1", "HI:i:1", "MD:Z:0T2^T2"]


def test_color_records(spark):
    bases = "ACGTTGCA"
    colors = "A" + colors_of(bases)
    wrong = colors[:4] + str((int(colors[4]) + 1) % 4) + colors[5:]
    qual = "".join(chr(33 + 10 + i) for i in range(8))
    rows = [(1, 1, 7, 5, "+", 300, 9, bases, "acgttgca"), (1, 1, 8, 6, "-", 200, 0, bases, "acgttgca"), (1, 1, 8, 90, "+", 200, 0, bases, "acgttgca")]
    ends = spark.createDataFrame([(1, "r", 1, wrong, qual), (2, "s", 1, wrong, qual)], ENDS)
    contigs = spark.createDataFrame([(7, "x"), (8, "y")], "contig long, name string")
    first, second, third, none = fields(sam.records(spark.createDataFrame(rows, ALIGNED), ends, contigs, space="color", quality=0, algorithm=4, tags="\tRG:Z:g"))
    errors = sam.color_errors(bases, bases, wrong)
    assert errors.count("-") == 7
    q = sam.color_base_qualities(bases, errors, qual, 0)
    color = [f"CS:Z:{wrong}", f"CQ:Z:{qual}", "CM:i:1"]
    assert first[9:] == [bases, q, "RG:Z:g", "PG:Z:seedloom", "AS:i:300", "NM:i:0", "NH:i:3", "IH:i:3", "HI:i:1", "MD:Z:8", *color, "CC:Z:y", "CP:i:6", "XA:i:4", f"XE:Z:{errors}"]
    assert second[9:11] == [sam.turned(bases), q[::-1]] and second[-4:] == ["CC:Z:y", "CP:i:90", "XA:i:4", f"XE:Z:{errors[::-1]}"]
    assert not any(x.startswith("CC:") for x in third)
    last, decoded = "A", []
    for c in wrong[1:]:
        last = "ACGT"["ACGT".index(last) ^ int(c)]
        decoded.append(last)
    assert none[:11] == ["s", "4", "*", "0", "0", "*", "*", "0", "0", "".join(decoded), sam.color_read_qualities(qual)]
    assert none[11:] == ["RG:Z:g", "PG:Z:seedloom", "AS:i:-2147483648", "NH:i:1", "IH:i:1", "HI:i:1", f"CS:Z:{wrong}", f"CQ:Z:{qual}", "CM:i:0", "XA:i:4"]


def test_parts_are_one_sorted_file(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, 1, rng.randint(1, 3), rng.randint(1, 50), "+", 100, 9, "ACGT", "ACGT") for i in range(200) if i % 9]
    ends = spark.createDataFrame([(i, f"r{i}", 1, "ACGT", "IIII") for i in range(200)], ENDS)
    contigs = spark.createDataFrame([(c, f"c{c}", 60) for c in (3, 1, 2)], "contig long, name string, length int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sam.write_sam(sam.records(spark.createDataFrame(rows, ALIGNED), ends, contigs), contigs, str(tmp_path / "s"), read_group="@RG\tID:g")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "s").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert len(parts) > 2 and len(lines) == 206
    assert lines[0] == "@HD\tVN:1.6\tSO:coordinate" and [x.split("\t")[1] for x in lines[1:4]] == ["SN:c1", "SN:c2", "SN:c3"]
    assert lines[4].startswith("@RG") and lines[5].startswith("@PG")
    places = [(x[2] == "*", x[2], int(x[3])) for x in (line.split("\t") for line in lines[6:])]
    assert places == sorted(places) and sum(p[0] for p in places) == len([i for i in range(200) if i % 9 == 0])
