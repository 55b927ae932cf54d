"""Stored indexes: met where they lie, refused a second time, whole with and without common keys."""

import random

import pytest
from pyspark.sql import functions as F

from seedloom.operators import match as m
from seedloom.operators.seeds import OUTSIDE, Mask, build_index, key_frequency, read_index, read_indexes, read_keys, seeds, stored_numbers, write_index

MASK = Mask("1110111", depth=2)


def reference(spark):
    rng = random.Random(5)
    return spark.createDataFrame([*[(i, "".join(rng.choices("acgt", k=700))) for i in range(1, 5)], (9, "a" * 300)], "contig long, seq string")


def reads(spark, ref):
    text = {r["contig"]: r["seq"] for r in ref.collect()}
    rows = [(1, 1, text[1][100:160]), (2, 1, text[2][5:40]), (3, 1, "a" * 20), (4, 1, "acg"), (5, 1, None)]
    return spark.createDataFrame(rows, "read_id long, end_no int, seq string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sought", [0, 1000])
@pytest.mark.parametrize("most", [8, 1000])
def test_match_is_that_of_an_index_that_isn_t_stored(spark, tmp_path, monkeypatch, sought, most):
    monkeypatch.setattr(m, "MOST_SOUGHT", sought)
    ref = reference(spark)
    build_index(ref, MASK, str(tmp_path / "i"), 2, common=100, buckets=3)
    index, frequency, mask = read_index(spark, str(tmp_path / "i"), 2)
    plain = seeds(ref, MASK)
    assert index.where(F.col("bin") == OUTSIDE).count() >= 294 and index.count() == plain.count() == frequency.agg(F.sum("n")).first()[0]
    options = m.MatchOptions(max_key_matches=most)
    for got, want in zip(m.match(reads(spark, ref), index, frequency, mask, options), m.match(reads(spark, ref), plain, key_frequency(plain), MASK, options)):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect())) != []


def test_no_seed_is_shuffled_and_other_bins_aren_t_read(spark, tmp_path, monkeypatch):
    """Many keys are dealt to the index's buckets: the only exchange beside its scan is theirs, and the scan names their bins."""
    monkeypatch.setattr(m, "MOST_SOUGHT", 0)
    ref = reference(spark)
    build_index(ref, MASK, str(tmp_path / "i"), buckets=3)
    index, frequency, mask = read_index(spark, str(tmp_path / "i"))
    keys = read_keys(reads(spark, ref), MASK).where("key < 200")
    for part in (index, frequency):
        plan = plan_of(m.of_keys(part, keys, mask))
        near = plan[plan.index("ShuffledHashJoin") :].split("Union")[0].split("BroadcastHashJoin")[0]
        scan = near[near.index("FileScan parquet spark_catalog") :].split("\n")[0]
        assert "Bucketed: true" in scan and "bin" in scan.split("PartitionFilters: ")[1].split("]")[0] and near.count("Exchange hashpartitioning(key") == 1
        assert near.index("FileScan parquet spark_catalog") < near.index("Exchange hashpartitioning")
        assert "bin=0" in scan or "InMemoryFileIndex" in scan
    got = m.of_keys(index, keys, mask)
    assert {r["bin"] for r in got.select("bin").distinct().collect()} <= {0}


def test_a_number_is_written_once(spark, tmp_path):
    path, ref = str(tmp_path / "i"), reference(spark)
    assert stored_numbers(spark, path) == []
    build_index(ref, MASK, path, 1)
    with pytest.raises(FileExistsError):
        build_index(ref, MASK, path, 1)
    with pytest.raises(FileExistsError):
        write_index(seeds(ref, MASK), MASK, path, 1)
    assert read_index(spark, path)[0].count() == seeds(ref, MASK).count()
    build_index(ref, Mask("11011"), path, 2)
    assert stored_numbers(spark, path) == [1, 2] and len(read_indexes(spark, path)) == 2
    with pytest.raises(ValueError):
        read_indexes(spark, path, [1, 3])


def test_a_cut_off_write_isn_t_there(spark, tmp_path):
    """The layout is written last: without it the number is free, and what lay there is written over."""
    path, ref = str(tmp_path / "i"), reference(spark)
    seeds(ref, Mask("11011")).withColumn("bin", F.lit(0)).write.partitionBy("bin").parquet(f"{path}/seeds/index_no=1")
    build_index(ref, MASK, path, 1)
    assert read_index(spark, path)[0].count() == seeds(ref, MASK).count()


def test_regions_have_to_be_the_same(spark, tmp_path):
    path, ref = str(tmp_path / "i"), reference(spark)
    build_index(ref, MASK, path, 1, region=((2, 10), (3, 50)))
    build_index(ref, Mask("11011"), path, 2, region=((2, 10), (3, 50)))
    build_index(ref, Mask("1111"), path, 3)
    build_index(ref, Mask("1111"), path, 4, region=((1, 1), (12, 1)))
    at = read_index(spark, path)[0].agg(F.min(F.struct("contig", "pos")).alias("a"), F.max(F.struct("contig", "pos")).alias("b")).first()
    assert tuple(at["a"]) == (2, 10) and tuple(at["b"]) == (3, 44)
    assert len(read_indexes(spark, path, [1, 2])) == len(read_indexes(spark, path, [3, 4])) == 2
    with pytest.raises(ValueError, match="regions"):
        read_indexes(spark, path, [1, 3])


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "contig long, seq string")
    build_index(none, MASK, str(tmp_path / "i"))
    index, frequency, mask = read_index(spark, str(tmp_path / "i"))
    cals, ends = m.match(spark.createDataFrame([(1, 1, "acgtacgtacgt")], "read_id long, end_no int, seq string"), index, frequency, mask)
    assert index.count() == 0 and cals.count() == 0 and ends.count() == 1


def test_neighbours_find_what_exact_keys_miss(spark, tmp_path):
    """Against a loop over all windows: a read with a changed base in each of its keys has places by near keys alone."""
    ref, mask = reference(spark), Mask("11011111")
    text = {r["contig"]: r["seq"] for r in ref.collect()}
    read = list(text[3][200:216])
    for at in (3, 4, 11):
        read[at] = "acgt"[("acgt".index(read[at]) + 1) % 4]
    read = "".join(read)
    build_index(ref, mask, str(tmp_path / "i"))
    index, frequency, _ = read_index(spark, str(tmp_path / "i"))
    rows = spark.createDataFrame([(1, 1, read)], "read_id long, end_no int, seq string")
    of = lambda s: [s[p] for p in mask.places]
    turn = str.maketrans("acgt", "tgca")
    for n in (0, 1, 2):
        options, want = m.MatchOptions(max_key_matches=10_000, max_matches=100_000, mismatches=n), set()
        for c, s in text.items():
            for at in range(len(s) - 7):
                for offset in range(len(read) - 7):
                    w = read[offset : offset + 8]
                    for strand, k, place in (("+", w, at + 1 - offset), ("-", w.translate(turn)[::-1], at + 1 + 8 + offset - 16)):
                        if sum(a != b for a, b in zip(of(k), of(s[at : at + 8]))) <= n:
                            want.add((c, place, strand))
        for cals, _ in (m.match(rows, index, frequency, mask, options), m.match_reference(rows, ref, mask, options)):
            assert {(r["contig"], r["position"], r["strand"]) for r in cals.collect()} == want
        assert ((3, 201, "+") in want) == (n > 0)
    assert len(m.neighbour_patterns(5, 2)) == len(set(m.neighbour_patterns(5, 2))) == 1 + 15 + 90
    with pytest.raises(ValueError):
        m.neighbour_patterns(31, 4)
