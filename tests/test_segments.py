"""Indexes in segments: whole, found by cell, and built without a shuffle of seeds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from seedloom import queries
from seedloom.operators import match as m
from seedloom.operators import seeds as s
from seedloom.operators import segments
from seedloom.operators.seeds import META, OUTSIDE, Mask, Texts, build_index, read_index, seeds


def texts(spark, parts=3):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "aaa bbb " * 20, "".join(rng.choices("acgtxyz ,", k=150))])) for i in range(40)] + [(-7, "ac gt " * 30), (99, "the last one of all, " * 4)]
    return Texts(spark.createDataFrame(rows, "contig long, text string").repartition(parts), queries.BASES)


def test_building_an_index_shuffles_no_seed(spark, tmp_path, monkeypatch):
    """Nothing that is written has an exchange behind it: neither seeds nor their counts."""
    ref = spark.createDataFrame([(1, "acgtgca" * 400)], "contig long, seq string")
    plans, real = [], DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1]))
    build_index(ref, Mask("1110111", depth=1), str(tmp_path / "i"))
    assert len(plans) == 2 and not any("Exchange" in p for p in plans) and plans[0].count("MapInArrow") == 1
    monkeypatch.undo()
    assert read_index(spark, str(tmp_path / "i"))[0].count() == 2794


@pytest.mark.parametrize("name", ["stored_index_join", "match_stream"])
def test_an_index_of_documents_is_written_where_they_are_read(spark, monkeypatch, name):
    """From texts to blocks is one task's work: a scan, one pass, and no exchange."""
    plans, real = [], DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1]))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    built = [p for p in plans if "key_cell" in p.splitlines()[0] or "alone" in p.splitlines()[0]]
    assert len(built) == 1 and "Exchange" not in built[0] and built[0].count("MapInArrow") == 1


@pytest.mark.parametrize("mask", [Mask("1110111"), Mask("1110111", depth=2), Mask("11", depth=2), Mask("1" * 31, depth=1), Mask("1" * 9, depth=7)], ids=str)
def test_blocks_hold_every_seed(mask, monkeypatch):
    """Segments of any size, with keys alone in theirs and without: what is opened is what was put in, and what is picked is what is wanted."""
    monkeypatch.setattr(segments, "SEGMENT", 1000)
    monkeypatch.setattr(segments, "PIECE", 16)
    rng, pa = np.random.default_rng(3), segments.pa
    key = np.concatenate([rng.integers(0, 4**mask.size, 1500), np.full(900, 5), [0, 4**mask.size - 1]])
    rows = [rng.integers(-3, 2**40, len(key)), rng.integers(1, 2**20, len(key)).astype(np.int32), key]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["contig", "pos", "key"])
    for common in (50, 10**6):
        found = list(segments.segments(iter([batch.slice(0, 700), batch.slice(700)]), mask, common))
        opened = [segments.Segments(None, mask, placed)._opener() for placed in (True, False)]
        got = [[tuple(r.values()) for b in o(iter(found)) for r in b.to_pylist()] for o in opened]
        assert sorted(r[:3] for r in got[0]) == sorted(zip(*(c.tolist() for c in rows)))
        want = dict(zip(*(x.tolist() for x in np.unique(key, return_counts=True))))
        assert sum(n for _, n in got[1]) == len(key) and all(sum(n for k, n in got[1] if k == x) == want[x] for x in (5, 0, int(key[7])))
        shift = 2 * (mask.size - mask.depth)
        assert all(b == k >> shift or (b == OUTSIDE and want[k] > common) for _, _, k, b in got[0])
        assert any(b == OUTSIDE for *_, b in got[0]) == (common == 50)
        wanted = np.unique(np.concatenate([key[::3], [1, 2]]))
        spread = np.sort(segments._spread(wanted, mask))
        assert (np.sort(segments._spread(spread, mask, True)) == wanted).all()
        cells = spread >> segments._shift(mask)
        own = {c: segments._key_blocks([0, int((cells == c).sum())], spread[cells == c])[0] for c in cells.tolist()}
        near = [b.filter(pa.array([a is None and c in own for a, c in zip(b["alone"].to_pylist(), b["key_cell"].to_pylist())])) for b in found]
        near = [pa.RecordBatch.from_arrays([*b.columns, pa.array([own[c] for c in b["key_cell"].to_pylist()], pa.binary())], names=[*b.schema.names, "wanted"]) for b in near if b.num_rows]
        picked = sorted(tuple(r.values()) for b in opened[0](iter(near)) for r in b.to_pylist())
        assert picked == sorted(r for r in got[0] if r[3] != OUTSIDE and r[2] in set(wanted.tolist()))
        assert max(len(b) for o in found for b in o["places"].to_pylist()) < 16_000


@pytest.mark.parametrize("most", [1 << 26, 500])
def test_texts_are_indexed_as_their_bases(spark, tmp_path, monkeypatch, most):
    """An index of texts, be they dealt anew or not, is that of their bases, and says so."""
    monkeypatch.setattr(s, "TASK_BASES", most)
    own, mask = texts(spark), Mask("110101", depth=1)
    ref = queries.encoded_rows(own.rows)
    want = sorted(map(tuple, seeds(ref, mask).collect()))
    keys = spark.createDataFrame([(k,) for k in sorted({r[2] for r in want})[::3] + [4**4 - 1]], "key long").distinct()
    sought = {r["key"] for r in keys.collect()}
    for number, reference in enumerate((own, ref)):
        build_index(reference, mask, str(tmp_path / "i"), number, buckets=2)
        index, frequency, same = read_index(spark, str(tmp_path / "i"), number)
        assert sorted(map(tuple, index.select("contig", "pos", "key").collect())) == want and same == mask
        counts = {r["key"]: r["n"] for r in frequency.collect()}
        assert counts == {k: sum(w[2] == k for w in want) for k in counts} and sum(counts.values()) == len(want)
        for limit in (0, 1000):
            monkeypatch.setattr(m, "MOST_SOUGHT", limit)
            assert sorted(map(tuple, m.of_keys(index, keys, mask).select("contig", "pos", "key").collect())) == [w for w in want if w[2] in sought]
            assert {r["key"]: r["n"] for r in m.of_keys(frequency, keys, mask).collect()} == {k: n for k, n in counts.items() if k in sought}
    meta = [tuple(r)[5:9] for r in spark.read.schema(META).parquet(str(tmp_path / "i/meta")).collect()]
    assert meta[0] == meta[1] == (-7, 1, 99, 60)


def test_an_index_of_another_layout_is_refused(spark, tmp_path):
    build_index(texts(spark), Mask("1101"), str(tmp_path / "i"))
    old = spark.read.schema(META).parquet(str(tmp_path / "i/meta")).drop("cells")
    old.write.parquet(str(tmp_path / "j/meta"))
    with pytest.raises(ValueError, match="another layout"):
        read_index(spark, str(tmp_path / "j"))
