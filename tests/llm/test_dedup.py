"""Exact dedup and SimHash against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom.llm import exact_dedup, simhash
from seedloom.llm.components import components

SCHEMA = "doc_id long, text string"
ROWS = [(1, "a"), (5, "a"), (3, "b"), (4, None), (2, ""), (9, "c"), (9, "c"), (None, "a"), (None, None), (7, "é\n")]


def want_dedup(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((d is not None, d or 0, i))
    out = []
    for t, members in groups.items():
        keep = max(members)
        out += [(d if known else None, keep[1] if keep[0] else None, len(members)) for known, d, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)])
def test_exact_dedup(spark, digest):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.dedup(docs, digest=digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == want_dedup(ROWS)
    assert sum(r.kept for r in got) == len({t or "" for _, t in ROWS})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    import hashlib

    assert {r.text_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}


def test_exact_dedup_keeps_columns_that_clash(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", 1, "p"), (2, "x", 2, "q"), (3, "y", 3, "r")], "doc_id long, text string, kept int, _file string")
    docs.write.parquet(str(tmp_path / "d"))
    rows = exact_dedup.kept_documents(spark.read.parquet(str(tmp_path / "d")))
    assert rows.columns == docs.columns and {tuple(r) for r in rows.collect()} == {(2, "x", 2, "q"), (3, "y", 3, "r")}
    assert exact_dedup.kept_documents(docs.where("false")).count() == 0


def test_state_goes_on_from_where_it_was(spark, tmp_path):
    state = exact_dedup.DedupState(spark, f"file://{tmp_path}/state")
    place = "doc_id long, text string, _file string, _row long"
    state.add(spark.createDataFrame([(1, "a", "f", 0), (2, "b", "f", 1)], place))
    state.add(spark.createDataFrame([(3, "a", "g", 0)], place))
    got = {(r.keeper.doc_id, r.group_size) for r in state.decisions().collect()}
    assert got == {(3, 2), (2, 1)}


def brute_components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 20), (60, 50), (40, 39)):
        edges = [(i, i + 1) for i in range(m)] if m == 39 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        want = brute_components(n, edges)
        assert all(got.get(i, i) == want[i] for i in range(n))


def plain_fingerprint(text):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for t in ("", " \n", "one", "One TWO\tthree", "a b c d", "a b c d e É é\x1cf g\u00a0h i", "x " * 70_000):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), t[:20]


def test_spark_hashes_shingles_alike(spark):
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_pairs_are_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(300)]
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 40, 300)] ^ np.array(flips, np.uint64)]))
    got = set(zip(*[x.tolist() for x in simhash.near_pairs(fps, radius, rng.permutation(64))]))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert got == want


def test_forest_joins_what_links_join():
    """Trees that met through a node other than their least fell apart."""
    links = np.array([(5, 6), (6, 1), (0, 2), (1, 6), (5, 2)])
    assert simhash.forest(7, *np.concatenate([links, links[:, ::-1]]).T).tolist() == [0, 0, 0, 3, 4, 0, 0]
    rng = np.random.default_rng(1)
    for _ in range(500):
        m = int(rng.integers(2, 14))
        a, b = rng.integers(0, m, (2, int(rng.integers(1, m + 2))))
        want = np.arange(m)
        for _ in range(m):
            np.minimum.at(want, a, want[b])
            np.minimum.at(want, b, want[a])
        assert simhash.forest(m, np.concatenate([a, b]), np.concatenate([b, a])).tolist() == want.tolist()


@pytest.mark.parametrize("cell,chunk", [(512, 1024), (4, 3)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(1, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            edited = list(base)
            edited[rng.randrange(len(edited))] = rng.choice(words)
            texts.append(" ".join(edited))
    texts += [None, "", "  ", texts[0]]
    rows = list(enumerate(texts, 100))
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [plain_fingerprint(t or "") for t in texts]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = brute_components(len(fps), edges)
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {100 + i: (fps[i], 100 + want[i]) for i in range(len(fps))}
    kept = simhash.kept_documents(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({100 + w for w in want})


def test_tables_cover_every_pair():
    """Whatever few bits differ, some table has both in one cell."""
    for n in (10, 10_000, 10**6, 10**8, 10**10):
        tables, bits = simhash.scheme(n, 4)
        for _ in range(100):
            off = set(random.sample(range(64), 4))
            assert any(not off & {i for o, w in t for i in range(o, o + w)} for t in tables)
        assert all(sum(w for _, w in t) >= bits for t in tables)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_simhash_radius_and_clashing_columns(spark):
    from seedloom.llm import simhash

    with pytest.raises(ValueError):
        simhash.near_pairs(np.array([0, 255], np.uint64), 8)
    rows = spark.createDataFrame([(1, "a b c d e", 9, 9, 9), (2, "a b c d e", 9, 9, 9)], "doc_id long, text string, fp long, root long, component_id long")
    assert [r.component_id for r in simhash.near_duplicates(rows).collect()] == [1, 1]


def test_dedup_add_may_be_repeated(spark, tmp_path):
    from seedloom.llm import exact_dedup
    from seedloom.llm.common import located

    spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string").write.parquet(str(tmp_path / "a"))
    state = exact_dedup.DedupState(spark, f"file://{tmp_path}/state")
    rows = located(spark.read.parquet(str(tmp_path / "a")), "again")
    for _ in range(2):
        state.add(rows)
    assert sorted((r.keeper.doc_id, r.group_size) for r in state.decisions().collect()) == [(2, 2), (3, 1)]
