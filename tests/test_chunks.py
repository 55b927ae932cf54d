"""Contigs cut into chunks against whole ones, at every border."""

import random

import pytest

from seedloom.operators import stats
from seedloom.operators.seeds import Mask, cut_contigs, seeds


def contigs(spark, rows):
    return spark.createDataFrame(rows, "contig long, seq string")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("space", ["nt", "color"])
def test_seeds_of_chunks_are_those_of_contigs(spark, space):
    rng, mask = random.Random(1), Mask("1101011")
    ref = contigs(spark, [(1, "".join(rng.choices("acgtACGTn", k=90))), (2, "acg"), (3, ""), (4, None), (5, "acgtacg")])
    whole = {repeats: rows_of(seeds(ref, mask, repeats, space=space)) for repeats in (False, True)}
    for size in (1, 2, 7, 30, 89, 90, 91):
        for repeats in (False, True):
            assert rows_of(seeds(cut_contigs(ref, mask.width - 1, size), mask, repeats, space=space).select("contig", "pos", "key")) == whole[repeats]


def test_chunks_are_dealt_to_many_tasks(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = cut_contigs(contigs(spark, [(1, "acgt" * 1000)]), 5, 100)
        assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeats_of_chunks_are_those_of_contigs(spark):
    rng = random.Random(2)
    made = []
    for i in range(12):
        parts = ["".join(rng.choices("acgt", k=rng.randint(0, 9))) if rng.random() < 0.4 else "".join(rng.choices("acgtn", k=rng.randint(1, 6))) * rng.randint(2, 15) for _ in range(8)]
        made.append((i, "".join(parts)))
    ref = contigs(spark, [*made, (100, "a" * 300), (101, ""), (102, None), (103, "ac" * 50 + "g" + "ac" * 50)])
    whole = rows_of(stats.tandem_repeats(ref))
    assert len(whole) > 20
    for size in (1, 3, 6, 7, 20, 64, 1000):
        assert rows_of(stats.tandem_repeats(ref, chunk=size)) == whole, size
