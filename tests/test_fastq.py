"""FASTQ files cut between tasks at every byte, and what isn't a record."""

import gzip
import random

import pytest

from seedloom.sources import fastq, sequences


def made(rng, n, wraps, fewer=0):
    """Records whose qualities abound in @ and +, in lines of any length."""
    out = []
    for i in range(n):
        length = rng.choice([1, 2, 3, 8, 20, rng.randint(1, 40)])
        seq, qual = "".join(rng.choices("ACGTNacgt.", k=length)), "".join(rng.choices("@+IIIA!~", k=length - fewer))
        w = rng.choice(wraps)
        lines = lambda s: "\n".join(s[k : k + w] for k in range(0, len(s), w))  # noqa: B023, E731
        out.append(f"@r{i} x\n{lines(seq)}\n+{rng.choice(['', f'r{i} x'])}\n{lines(qual)}\n")
    return "".join(out).encode()


def read(path, size, cuts, margin, space="nt"):
    reader = fastq.FastqReader({"path": path, "marginbytes": str(margin), "space": space})
    return [tuple(r.values()) for a, b in zip(cuts, cuts[1:]) for batch in reader.read(fastq.Range(path, a, b, size)) for r in batch.to_pylist()]


@pytest.mark.parametrize("seed", range(12))
def test_a_file_cut_anywhere_has_the_same_records(tmp_path, seed):
    rng, fewer = random.Random(seed), int(seed % 4 == 3)
    path, space = str(tmp_path / "a.fq"), "color" if fewer else "nt"
    data = made(rng, rng.randint(1, 20), [3, 5, 10, 1000] if seed % 2 else [1000], fewer)
    (tmp_path / "a.fq").write_bytes(data)
    n = len(data)
    whole = read(path, n, [0, n], 64, space)
    assert len(whole) == data.count(b" x\n") - data.count(b"+r")
    for cut in range(1, n):
        assert read(path, n, [0, cut, n], 16, space) == whole
    assert read(path, n, [*range(0, n, 7), n], 32, space) == whole


def test_small_reads_from_the_file(tmp_path, monkeypatch):
    monkeypatch.setattr(fastq, "BUFFER", 5)
    data = made(random.Random(1), 15, [4, 1000])
    (tmp_path / "a.fq").write_bytes(b"\n\nnothing\n" + data)
    n = len(data) + 10
    whole = read(str(tmp_path / "a.fq"), n, [0, n], 64)
    assert len(whole) == 15 and read(str(tmp_path / "a.fq"), n, [0, 11, 40, n], 64) == whole


def test_what_isn_t_a_record(tmp_path):
    for text, what in ((b"@a\nAC\n+\nI\n", "length"), (b"@a\nAC\n+\nIII\n", "length"), (b"@a\nAC\n", "ends"), (b"@a\nA!C\n+\nIII\n", "letters"), (b"@a\nAC\n+b\nII\n", "name")):
        (tmp_path / "a.fq").write_bytes(text)
        with pytest.raises(fastq.Malformed, match=what):
            read(str(tmp_path / "a.fq"), len(text), [0, len(text)], 64)
    (tmp_path / "a.fq").write_bytes(b"")
    assert read(str(tmp_path / "a.fq"), 0, [0, 0], 64) == []


def test_spark_reads_files_in_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    for k in range(2):
        (tmp_path / f"{k}.fq").write_bytes(made(rng, 300, [7, 1000]))
    with gzip.open(tmp_path / "2.fq.gz", "wb") as f:
        f.write(made(rng, 50, [7]))
    rows = sequences.read_fastq(spark, str(tmp_path), split_bytes=1000)
    assert rows.rdd.getNumPartitions() > 10 and rows.count() == 650
    files = {f: [r["name"] for r in rows.where(rows.file.endswith(f)).orderBy("at").collect()] for f in ("0.fq", "1.fq", "2.fq.gz")}
    assert files == {"0.fq": [f"r{i}" for i in range(300)], "1.fq": [f"r{i}" for i in range(300)], "2.fq.gz": [f"r{i}" for i in range(50)]}


def test_written_reads_come_back(spark, tmp_path):
    reads = spark.createDataFrame([(f"x_{i}", "ACGT" * i, "I@+#" * i) for i in range(1, 40)], "name string, seq string, qual string")
    for width in (0, 7):
        sequences.write_fastq(reads, str(tmp_path / f"w{width}"), width)
        back = sequences.read_fastq(spark, str(tmp_path / f"w{width}"), split_bytes=50).select("name", "seq", "qual")
        assert sorted(back.collect()) == sorted(reads.collect())


def test_files_of_exactly_so_many_reads(spark, tmp_path):
    reads = spark.createDataFrame([(f"b_{i % 5}_{i}", "AC", "II") for i in range(103)], "name string, seq string, qual string").repartition(5)
    sequences.write_split(reads, 20, str(tmp_path / "s"))
    order = sorted((f"b_{i % 5}_{i}" for i in range(103)), key=lambda x: [int(y) for y in x.split("_")[1:]])
    for k in range(6):
        (file,) = (tmp_path / "s" / f"file={k + 1}").glob("part-*")
        assert [line[1:] for line in file.read_text().splitlines()[::4]] == order[20 * k : 20 * k + 20]


@pytest.mark.parametrize("lanes", [(), ("lane",)])
def test_ends_are_grouped_over_parts(spark, lanes):
    """Runs of one name go over any number of ranges; null names are one name."""
    rng, rows, at = random.Random(4), [], 0
    for run in range(40):
        name = rng.choice(["a", "b", None])
        for _ in range(rng.choice([1, 2, 3, 60 if run % 13 == 5 else 1])):
            rows.append((at // 45, at, name))
            at += 1
    want, groups, before, n = {}, {}, object(), 0
    for lane, at, name in rows:
        key = (lane, name) if lanes else name
        n = n + 1 if key == before else 1
        which = lane if lanes else 0
        groups[which] = groups.get(which, 0) + (n == 1)
        want[at], before = (groups[which], n), key
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = sequences.grouped_ends(spark.createDataFrame(rows, "lane int, at int, name string").repartition(3), ["at"], lanes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["at"]: (r["group"], r["end_no"]) for r in got} == want and len(got) == len(rows)


def test_keys_of_both_strands_by_any_mask(spark):
    from collections import Counter

    from seedloom.operators import stats
    from seedloom.operators.seeds import Mask, key_text, seeds

    rng, mask = random.Random(3), Mask("110100101")
    text = "".join(rng.choices("acgtn", [4, 4, 4, 4, 1], k=400))
    turn = str.maketrans("acgtn", "tgcan")
    of = lambda w: "".join(w[i] for i in mask.places)
    windows = [text[i : i + mask.width] for i in range(len(text) - mask.width + 1)]
    forward = Counter(k for w in windows if "n" not in (k := of(w)))
    backward = Counter(k for w in windows if "n" not in (k := of(w.translate(turn)[::-1])))
    ref = spark.createDataFrame([(1, text)], "contig long, seq string")
    from pyspark.sql import functions as F

    index, turned = seeds(ref, mask), stats.turned_seeds(ref, mask)
    got = stats.key_distribution(index, mask, turned).select(key_text(F.col("key"), mask.size).alias("key"), "forward", "both").collect()
    assert {r["key"]: (r["forward"], r["both"]) for r in got} == {k: (forward[k], forward[k] + backward[k]) for k in forward | backward}
    times = Counter((forward + backward).values())
    assert {r["times"]: r["keys"] for r in stats.key_histogram(index, mask, turned).collect()} == times
    with pytest.raises(ValueError):
        stats.key_distribution(index, mask)
