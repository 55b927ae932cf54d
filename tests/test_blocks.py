"""Keys counted in blocks and seeds cut by batches of contigs: those of plain rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom import queries
from seedloom.operators import blocks, match, seeds, stats
from seedloom.operators.seeds import Mask


def reference(spark, parts=3):
    rng = random.Random(2)
    rows = [(i, None if i % 11 == 0 else "".join(rng.choices("acgtN", [9, 3, 3, 3, 1], k=rng.choice([0, 3, 12, 90])))) for i in range(40)]
    return spark.createDataFrame(rows, "contig long, seq string").repartition(parts)


def test_blocks_give_back_numbers():
    for columns in ([[], []], [[0, 0], [1, 2**40]], [[-5, 7, 300], [255, 256, 0]]):
        assert [c.tolist() for c in blocks.unpacked(blocks.packed(*map(np.array, columns)), 2)] == columns
    keys = np.arange(0, 4**7, 37)
    assert len(np.unique(blocks._turned(keys, 7))) == len(keys) and (blocks._turned(blocks._turned(keys, 7), 7, True) == keys).all()


def seeds_by_hand(rows, mask):
    out = []
    for r in rows:
        s = r["seq"] or ""
        for at in range(len(s) - mask.width + 1):
            w = [s[at + p] for p in mask.places]
            if "N" not in w:
                out.append((r["contig"], at + 1, sum("acgt".index(c) << 2 * k for k, c in enumerate(reversed(w)))))
    return out


@pytest.mark.parametrize("text", ["1101", "1", "111111", "1010011"])
def test_counts_are_those_of_rows(spark, monkeypatch, text):
    monkeypatch.setattr(blocks, "HELD", 50)
    monkeypatch.setattr(seeds, "BATCH", 17)
    mask, ref = Mask(text), reference(spark)
    want = seeds_by_hand(ref.collect(), mask)
    rows = seeds.seeds(ref, mask)
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    n = {k: sum(w[2] == k for w in want) for k in {w[2] for w in want}}
    for got in (blocks.counted_keys(ref, mask), blocks.counted_rows(rows, mask)):
        got = got.collect()
        assert {r["key"]: r["n"] for r in got} == n and len(got) == len(n)
    turned = stats.turned_seeds(ref, mask)
    for got, old in ((stats.reference_keys(ref, mask), stats.key_distribution(rows, mask, turned)), (stats.reference_histogram(ref, mask), stats.key_histogram(rows, mask, turned))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.collect())) != []


def test_no_row_a_seed_is_shuffled(spark):
    """What key counts shuffle are blocks, fewer than seeds."""
    ref = spark.range(1, 2).selectExpr("id AS contig", "repeat('acgtgca', 30000) AS seq")
    plan = blocks.counted_keys(ref, Mask("1" * 9))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "block" in plan[plan.index("Exchange") :]
    assert blocks.counted_keys(ref, Mask("1" * 9)).agg(F.sum("n"), F.count("key")).first() == (209992, 7)


def test_exons_that_overlap_count_a_window_once(spark):
    ref, mask = reference(spark), Mask("1101")
    rng = random.Random(4)
    rows = [(c, a, a + rng.randint(-2, 30)) for c in range(40) for a in rng.choices(range(-3, 95), k=4)]
    exons = spark.createDataFrame(rows, "contig long, start int, end int")
    want = [w for w in seeds_by_hand(ref.collect(), mask) if any(c == w[0] and a <= w[1] and w[1] + 3 <= b for c, a, b in rows)]
    for got in (seeds.seeds(seeds.cut_exons(ref, mask, exons), mask), seeds.in_exons(seeds.seeds(ref, mask), mask, exons)):
        assert sorted(map(tuple, got.collect())) == sorted(want) != []


def test_encoded_texts_are_those_of_expressions(spark):
    texts = [None, "", "A b-c", "ÄÖİxyz\n", "12", "Zz" * 700] + [f"word {i} Ça" for i in range(2100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "contig long, text string").coalesce(1)
    got = queries.encoded_rows(rows).join(rows, "contig").select("seq", queries.encoded(F.col("text")).alias("want")).collect()
    assert len(got) == len(texts) and all(r["seq"] == r["want"] for r in got)


def test_what_is_dealt_to_buckets_are_blocks(spark, monkeypatch):
    """All seeds, each in the bucket that Spark's own dealing by key gives it, and no row a seed in the shuffle."""
    monkeypatch.setattr(blocks, "HELD", 300)
    ref, mask = reference(spark), Mask("1101")
    rows = seeds.seeds(ref, mask).withColumn("contig", F.col("contig") - 7)
    got = blocks.dealt(rows, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())) != []
    per_key = got.withColumn("part", F.spark_partition_id()).groupBy("key").agg(F.count_distinct("part").alias("n"))
    assert per_key.where("n > 1").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "hashpartitioning(key" not in plan


OPTIONS = [dict(max_key_matches=3), dict(max_key_matches=1, key_miss_fraction=0.2), dict(max_key_matches=40, max_matches=5), dict(max_key_matches=40, max_matches=60, strands="-"), dict(max_key_matches=6, space="color"), dict(max_key_matches=9, mismatches=1, offsets=(0, 2))]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_many_keys_meet_the_reference_in_blocks(spark, monkeypatch, options):
    """Reads of many keys find what reads of few do, and the state of their ends is the same, though neither seeds nor keys are shuffled as rows."""
    rng = random.Random(9)
    text = ["".join(rng.choices("acgtN", [9, 3, 3, 3, 1], k=200)) for _ in range(6)]
    ref = spark.createDataFrame(list(enumerate([*text, text[0][50:120], None, "ac"], -2)), "contig long, seq string").repartition(3)
    turned = str.maketrans("acgt", "tgca")
    rows = [(i - 3, 1 + i % 2, s) for i, s in enumerate([text[0][20:60], text[3][100:131].translate(turned)[::-1], "a" * 12, "acg", None, *["".join(rng.choices("acgt", k=30)) for _ in range(9)]])]
    if options.get("space") == "color":
        rows = [(i, e, s and "T" + s.translate(str.maketrans("acgtN", "0123."))) for i, e, s in rows]
    reads, mask = spark.createDataFrame(rows, "read_id long, end_no int, seq string").repartition(2), Mask("11011")
    options, found = match.MatchOptions(**options), {}
    monkeypatch.setattr(blocks, "HELD", 60)
    for most in (1 << 20, 0):
        monkeypatch.setattr(match, "MOST_SOUGHT", most)
        cals, ends = match.match_reference(reads, ref, mask, options)
        found[most] = cals.schema.simpleString(), sorted(map(str, cals.collect())), sorted(map(str, ends.select("read_id", "end_no", "max_reached", "cals").collect()))
    assert found[0] == found[1 << 20] and len(found[0][2]) > 8
    keys = match.query_keys(reads, mask, options).withColumn("strand", F.lit(0))
    plan = blocks.met(ref, keys, mask, ["read_id", "offset"], 3, space=options.space)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(cell") == 1


def test_likely_keys_hold_all_that_are_sought(spark):
    keys = [0, 5, 4**31 - 1, *range(1000, 90_000, 7)]
    table = blocks.likely(spark.createDataFrame([(k,) for k in keys], "key long").repartition(3), len(keys))
    every = np.concatenate([np.array(keys), np.arange(10**12, 10**12 + 100_000)])
    at = table.among(every)
    assert set(range(len(keys))) <= set(at.tolist()) and len(at) < len(keys) + 30_000


@pytest.mark.parametrize("space", ["nt", "color"])
def test_texts_are_turned_in_the_scan(spark, space):
    """Seeds of texts are those of their bases, and bases don't leave the task that makes them."""
    rng = random.Random(3)
    texts = [None, "", "A b-c", "ÄÖİxyz\n", "12", "word one, Word two. " * 9] + ["".join(rng.choices("abcXYZ é,1", k=rng.choice([0, 4, 60]))) for _ in range(2100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "contig long, text string").coalesce(1)
    own, ref, mask = seeds.Texts(rows, queries.BASES), queries.encoded_rows(rows), Mask("1101")
    got = seeds.seeds(own, mask, space=space)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, seeds.seeds(ref, mask, space=space).collect())) != []
    assert sorted(map(tuple, blocks.counted_keys(own, mask, space=space).collect())) == sorted(map(tuple, blocks.counted_keys(ref, mask, space=space).collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["merged_bins", "binned_join"])
def test_an_index_of_sought_seeds_scans_the_reference_once(spark, monkeypatch, name):
    """What is written twice over is read from storage: no scan of the reference stands behind it."""
    plans = []
    real = queries.write_index
    monkeypatch.setattr(queries, "write_index", lambda rows, *rest: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), real(rows, *rest)))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
