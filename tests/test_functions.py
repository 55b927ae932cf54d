"""Column functions, SAM fields and files."""

import pytest
from pyspark.sql import functions as F

from seedloom.functions import bases, sam
from seedloom.operators import simulate
from seedloom.sources import sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bases(spark):
    assert one(spark, bases.reverse_complement(F.lit("ACgtN"))) == "NacGT"
    assert one(spark, bases.normalised(F.lit("AUuRyk"))) == "ATtNnn"
    assert [one(spark, bases.base_code(F.lit(c))) for c in "AcGtN."] == [0, 1, 2, 3, 4, 4]
    assert one(spark, bases.colors(F.lit("AACGTN"))) == "001314"
    assert one(spark, bases.colors(F.lit(""))) == ""
    assert one(spark, bases.bases_of_colors(F.lit("001314"))) == "AACGTN"
    assert one(spark, bases.bases_of_colors(F.lit("0.1"))) == "ANC"
    assert one(spark, bases.normalised_color_read(F.lit("T012"))) == "A312"
    assert one(spark, bases.cleaned_read(F.lit("ac .g\n"))) == "ACNG"
    assert abs(one(spark, bases.add_log10(F.lit(-1.0), F.lit(-2.0))) - -0.958607314841775) < 1e-12
    assert bases.number_list("1,5-6,10") == [1, 5, 6, 10]


def test_cigar_md_and_gaps():
    assert sam.cigar_of("ac--gt", "acttgt") == "2M2D2M" and sam.cigar_of("acgt", "a--t") == "1M2I1M"
    assert sam.md_of("acgt", "acgt") == ("4", 0)
    assert sam.md_of("acct", "acgt") == ("2G1", 1)
    assert sam.md_of("ac-t", "acgt") == ("2^G1", 1)
    assert sam.md_of("aact", "a-gt") == ("1G1", 2)
    assert sam.md_of("ccgt", "acgt") == ("0A3", 1)
    assert sam.md_of("acgc", "acgt") == ("3T0", 1)
    assert sam.md_of("cc-t", "aagt") == ("0A0A0^G1", 3)
    assert sam.moved_left("acaaa-t", "acaaaat") == ("ac-aaat", "acaaaat")
    assert sam.moved_left("gaaat", "g-aat") == ("gaaat", "g-aat")
    assert sam.moved_left("gaaat", "gaa-t") == ("gaaat", "g-aat")


def test_flags_and_lengths(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, sam.flag(f, f, t, f, t, f, F.lit(1), f)) == 16
    assert one(spark, sam.flag(t, t, t, t, f, t, F.lit(2), f)) == 1 + 2 + 32 + 128
    assert one(spark, sam.flag(t, f, f, f, f, f, F.lit(1), f)) == 1 + 4 + 8 + 64
    size = lambda a, b: one(spark, sam.insert_length(F.lit(a), F.lit(10), F.lit(b), F.lit(10), t))
    assert size(100, 150) == 60 and size(150, 100) == -60
    assert one(spark, sam.base_quality(F.lit(20), F.lit(5), F.lit(False), F.lit(True))) == 15


def test_read_group():
    assert sam.read_group_tags("@RG\tID:a\tLB:b\tSM:c") == "\tRG:Z:a\tLB:Z:b"
    with pytest.raises(ValueError):
        sam.read_group_tags("@RG\tSM:c")


def test_records_of_a_pair_with_one_end_placed(spark):
    a = spark.createDataFrame([(1, 1, 7, 5, "-", 200, 9, "acgt", "acgt")], "read_id long, end_no int, contig long, position long, strand string, score int, mapq int, aln_read string, aln_ref string")
    ends = spark.createDataFrame([(1, "r", 1, "ACGT", "IIIJ"), (1, "r", 2, "GG", "II"), (2, "s", 1, "A", "I"), (3, "t", 1, "A", "I"), (3, "t", 2, "A", "I"), (3, "t", 3, "A", "I")], "read_id long, name string, end_no int, seq string, qual string")
    lines = [r.line for r in sam.records(a, ends, spark.createDataFrame([(7, "chr")], "contig long, name string")).orderBy("read_id", "end_no").collect()]
    assert len(lines) == 3
    assert lines[0].split("\t")[:11] == ["r", str(1 + 8 + 16 + 64), "chr", "5", "9", "4M", "=", "5", "0", "ACGT", "JIII"]
    assert lines[1].split("\t")[:9] == ["r", str(1 + 4 + 32 + 128), "chr", "5", "0", "*", "chr", "5", "0"]
    assert lines[2].split("\t")[:9] == ["s", "4", "*", "0", "0", "*", "*", "0", "0"] and "AS:i:-2147483648" in lines[2]


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGU\nryN\n>two\n\nacgt\n")
    ref = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    want = [(1, "one", "ACGTnnN"), (2, "two", "acgt")]
    assert [tuple(r) for r in ref.orderBy("contig").collect()] == want
    sequences.write_fasta(ref, str(tmp_path / "out"))
    assert [tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "out")).orderBy("contig").collect()] == want


def test_fastq_over_several_lines(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACG\nTA\n+\nII@\n@I\n@r2\nA\n+r2\n@\n")
    rows = sequences.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("at").collect()
    assert [(r.name, r.seq, r.qual) for r in rows] == [("r1", "ACGTA", "II@@I"), ("r2", "A", "@")]


def test_ends_and_files(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "at int, name string")
    got = sequences.grouped_ends(rows, ["at"]).orderBy("at").collect()
    assert [(r.group, r.end_no) for r in got] == [(1, 1), (1, 2), (2, 1), (3, 1)]
    assert [(r.at, r.n) for r in sequences.numbered(rows, ["at"], 2, 3).collect()] == [(2, 2), (3, 3)]
    left = spark.createDataFrame([("1_2_F3", "T012"), ("1_3_F3", "T1")], "name string, value string")
    right = spark.createDataFrame([("1_2_F3", "10 -1 3"), ("9_F3", "1")], "name string, value string")
    assert {tuple(r) for r in sequences.color_reads(left, right).collect()} == {("1_2", "T012", "+!$"), ("1_3", "T1", None), ("9", None, '"')}
    ill = spark.createDataFrame([("x", "AC.GT", "hhBhh")], "name string, seq string, qual string")
    assert tuple(sequences.illumina_reads(ill, 2).first()) == ("x", "AC", "NGT", "#II")
    assert [one(spark, sequences.natural_key(F.lit(x))) for x in ("1_20_3", "1_3_20")] == ["000000000001_000000000020_000000000003", "000000000001_000000000003_000000000020"]


def test_simulated_names_tell_the_truth(spark):
    ref = spark.createDataFrame([(1, "acgtgca" * 30), (2, "acg")], "contig long, seq string")
    rows = simulate.simulated(ref, 5, 20, snps=2, insertion=3)
    told = rows.select("contig", "position", "strand", *[c.alias(f"t{i}") for i, c in enumerate(simulate.truth_of(F.col("name")))]).collect()
    assert len(told) == 5 and all((r.contig, r.position, r.strand) == (r.t0, r.t1, r.t2) for r in told)
    assert {len(r.seq) for r in rows.collect()} == {20}
    assert sorted(rows.collect()) == sorted(rows.repartition(3).collect())


def test_seed_sets(spark):
    got = {r.masks: (r.found, r.profiles) for r in simulate.seed_accuracy(spark, ["111", "1011"], 6, 1).collect()}
    assert got == {1: (6, 6), 2: (6, 6)}
    assert simulate.better_set(spark, ["111111", "11"], 1, 6, 1) == ["11"]


def test_seed_variants(spark):
    w = spark.createDataFrame([(1, "acgta")], "read_id long, window string")
    got = lambda **k: {r.window for r in simulate.seed_variants(w, "1101", **k).collect()}
    assert got() == {"acgt"}
    want = {"acgt"[:p] + b + "acgt"[p + 1 :] for p in (0, 1, 3) for b in "acgt"}
    assert got(mismatches=1) == want and len(got(mismatches=2)) == len({x[:p] + b + x[p + 1 :] for x in want for p in (0, 1, 3) for b in "acgt"})
    assert got(insertions=1) == {"acgt", "cgta", "agta", "acga"}
    assert got(deletions=1) == {"acgt"} | {("acgta"[:p] + b + "acgta"[p:])[:4] for p in (0, 1, 3) for b in "acgt"}


def test_random_mask():
    m = simulate.random_mask(5, 9, 3)
    assert len(m) == 9 and m.count("1") == 5 and m[0] == m[-1] == "1" and m == simulate.random_mask(5, 9, 3)


def test_mask_words_are_places(spark):
    """Bits by words of 32 places against the account place by place, over borders of words."""
    import random

    rng = random.Random(3)
    rows = []
    for length in (1, 31, 32, 33, 64, 65, 130):
        for _ in range(6):
            rows.append((length, sorted(rng.sample(range(length), min(length, rng.randint(0, 6)))), rng.choice("+-")))
    df = spark.createDataFrame(rows, "length int, offsets array<int>, strand string")
    for mask in ("1", "1101", "1" + "01" * 20, "1" * 62, "1" + "0" * 60 + "1"):
        args = (F.col("offsets"), F.col("length"), mask, F.col("strand"))
        assert df.where(bases.mask_of(*args) != bases._mask_by_places(*args)).count() == 0
        got = df.select(bases.mask_of(*args).alias("m"), "*").collect()
        own = {"+": mask, "-": mask[::-1]}
        assert all(r.m == "".join("1" if any(0 <= p - o < len(mask) and own[r.strand][p - o] == "1" for o in r.offsets) else "0" for p in range(r.length)) for r in got)


def test_profiles_that_masks_fit(spark):
    rows = spark.createDataFrame([("0110",), ("1101",), ("1011",), ("0000",), ("11",)], "profile string")
    got = {r.masks: (r.profiles, r.found) for r in simulate.profile_accuracy(rows, ["1101", "11"]).collect()}
    assert got == {1: (5, 1), 2: (5, 4)}


def test_seed_variants_in_gaps(spark):
    """Bases left out or added in a gap move what lies behind it; every key that they make is that of the window with that change."""
    mask, read = "1100101", "acgtacgtac"
    w = spark.createDataFrame([(1, read)], "read_id long, window string")
    got = lambda **k: {r.window for r in simulate.seed_variants(w, mask, **k).collect()}
    assert simulate.gaps(mask) == [(2, 2), (5, 1)]
    own = read[:7]
    assert got(gap_insertions=9) == {own, read[:2] + read[3:8], read[:2] + read[4:9], read[:5] + read[6:8]}
    assert got(gap_insertions=1) == {own, read[:2] + read[3:8], read[:5] + read[6:8]}
    assert got(gap_deletions=9) == {own, read[:2] + "n" + read[2:6], read[:2] + "nn" + read[2:5], read[:5] + "n" + read[5:6]}
    short = spark.createDataFrame([(1, read[:8])], "read_id long, window string")  # too short for two bases more
    assert {r.window for r in simulate.seed_variants(short, mask, gap_insertions=2).collect()} == {own, read[:2] + read[3:8], read[:5] + read[6:8]}
