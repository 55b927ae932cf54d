"""FASTA files cut at every byte against a plain account of their contigs."""

import random

import pytest

from seedloom.operators.seeds import Mask, seeds
from seedloom.sources import fasta, sequences
from seedloom.sources.fastq import Malformed, Range


def made(rng, n):
    out = []
    for i in range(n):
        seq, w = "".join(rng.choices("acgtN", k=rng.choice([0, 1, 5, 20, 37]))), rng.choice([1, 4, 10, 100])
        out.append(f">c{i} about\n" + "".join(seq[k : k + w] + "\n" for k in range(0, len(seq), w)) + ("\n" if rng.random() < 0.2 else ""))
    return "".join(out)


def plain(text):
    found = []
    for line in text.split("\n"):
        if line.startswith(">"):
            found.append([(line[1:].split() or [""])[0], ""])
        elif found:
            found[-1][1] += line.strip()
    return found


def read(path, size, cuts, after, before, chunk):
    reader = fasta.FastaReader({"path": path, "marginbytes": "3", "after": str(after), "before": str(before), "chunk": str(chunk)})
    return [r for a, b in zip(cuts, cuts[1:]) for batch in reader.read(Range(path, a, b, size)) for r in batch.to_pylist()]


@pytest.mark.parametrize("seed", range(6))
def test_a_file_cut_anywhere_has_the_same_contigs(tmp_path, seed):
    rng = random.Random(seed)
    text = made(rng, rng.randint(1, 5))
    text = text if seed % 2 else text.rstrip("\n")
    (tmp_path / "a.fa").write_text(text)
    n, want = len(text), plain(text)
    for cuts in [[0, c, n] for c in range(1, n)] + [[*range(0, n, 3), n], [*range(0, n, 1), n]]:
        for after, before, chunk in ((6, 1, 7), (0, 0, 100), (9, 2, 1)):
            got, at = [], 0
            for r in read(str(tmp_path / "a.fa"), n, cuts, after, before, chunk):
                if r["first"]:
                    got.append([r["name"], ""])
                own = r["seq"][r["lead"] : r["lead"] + r["own"]]
                at = len(got[-1][1])
                whole = want[len(got) - 1][1]
                assert r["seq"][r["lead"] :] == whole[at : at + r["own"] + after] or not r["own"], (cuts, r)
                assert not r["own"] or r["seq"][: r["lead"]] == whole[max(0, at - before) : at], (cuts, r)
                got[-1][1] += own
            assert got == want, cuts


def test_no_header(tmp_path):
    (tmp_path / "a.fa").write_text("acgt\n>x\nac\n")
    with pytest.raises(Malformed):
        read(str(tmp_path / "a.fa"), 11, [0, 11], 0, 0, 10)


def test_chunks_of_files_are_whole_contigs(spark, tmp_path):
    rng = random.Random(8)
    for k in range(2):
        (tmp_path / f"{k}.fa").write_text(made(rng, 12))
    want = [c for k in range(2) for c in plain((tmp_path / f"{k}.fa").read_text())]
    mask = Mask("11011")
    ref = spark.createDataFrame([(i + 1, s) for i, (_, s) in enumerate(want)], "contig long, seq string")
    whole = {space: sorted(map(tuple, seeds(ref, mask, space=space).collect())) for space in ("nt", "color")}
    for split in (5, 40, 1 << 20):
        chunks, names = fasta.read_chunks(spark, str(tmp_path), mask.width - 1, 6, split_bytes=split, margin_bytes=4)
        assert sorted(map(tuple, names.select("contig", "name", "length").collect())) == [(i + 1, name, len(s)) for i, (name, s) in enumerate(want)]
        for space in ("nt", "color"):
            assert sorted(map(tuple, seeds(chunks, mask, space=space).select("contig", "pos", "key").collect())) == whole[space]
    assert sequences.read_fasta(spark, str(tmp_path)).count() == len(want)


def test_small_ranges_share_a_task(spark, tmp_path):
    """Ranges of a few bytes are read by a few tasks, in order, and no chunk is shuffled to tell its place."""
    rng = random.Random(5)
    for k in range(3):
        (tmp_path / f"{k}.fa").write_text(made(rng, 20) + ">long\n" + "acgtacg\n" * 40)
    reader = fasta.FastaReader({"path": str(tmp_path), "splitbytes": "16", "tasks": "4", "after": "2"})
    parts, one = reader.partitions(), fasta.FastaReader({"path": str(tmp_path), "splitbytes": "16", "after": "2"}).partitions()
    assert len(parts) <= 6 < len(one) and [r for p in parts for r in p.own] == [p.own[0] for p in one]
    rows = lambda every: [r for p in every for b in reader.read(p) for r in b.to_pylist()]
    assert rows(parts) == rows(one)
    chunks, names = fasta.read_chunks(spark, str(tmp_path), 2, 6, split_bytes=16)
    assert chunks.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert all("seq" not in line for line in plan.split("BroadcastExchange")[1].split("\n") if "Exchange hashpartitioning" in line) and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
    places = sorted((r["contig"], r["start"], r["own"]) for r in chunks.collect())
    for before, now in zip(places, places[1:]):
        assert now[1] == (1 if now[0] > before[0] else before[1] + before[2])
    assert names.where("name = 'long'").agg({"length": "min"}).first()[0] == 280
