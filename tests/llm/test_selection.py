"""Importance resampling, the divergence audit and token files against brute force, exact round trips and the tokenizer itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom.llm import divergence, importance, token_files
from seedloom.llm.queries import tokenizer_path

WORDS = ["alpha", "Beta", "é", "ÉTÉ", "x1", "9", "don't", "漢字", "a-b", "THE", "the", "of"]


def text_of(rng, most):
    return None if rng.random() < 0.1 else rng.choice([" ", "\n", " , "]).join(rng.choices(WORDS, k=rng.randint(0, most)))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Importance resampling


def resampled_brute(docs, target, buckets, longest, percent, least, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t_ = Counter(bucket(f) for t in target for f in features(t)[1])
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t_.values()) + buckets))))
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    some = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = some[: percent * len(some) // 100]
    rank = Counter()
    out = [(*r, k + 1) for k, r in enumerate(drawn)]
    rank.update(drawn)
    for r in rows:
        if rank[r]:
            rank[r] -= 1
        else:
            out.append((*r, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,longest,ids", [(0, 1, 9), (1, 1, 9), (300, 1, 1000), (300, 3, 40), (200, 2, 1)])
def test_resampling_against_brute_force(spark, n, longest, ids):
    rng = random.Random(n + longest)
    docs = [(None if rng.random() < 0.05 else rng.randrange(ids), text_of(rng, 12)) for _ in range(n)]
    docs += docs[: n // 3]
    target = [text_of(rng, 12) for _ in range(20)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score long, rank string").repartition(3)
    got = importance.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), 50, longest, 30, 3, "s")
    assert sorted(map(tuple, got.collect()), key=str) == resampled_brute(docs, target, 50, longest, 30, 3, "s")


def test_ranks_of_one_score_are_numbered_over_parts(spark):
    """All rows have one score: the draw is the smallest ids, whatever part they fall in."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.lit(7).cast("long").alias("score"))
    got = importance.ranked(rows.repartition(5), F.lit(True), 40).where("rank is not null").orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(i, i + 1) for i in range(2000)]


def test_nothing_to_draw_and_no_target(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    got = importance.resampled(docs, spark.createDataFrame([], "text string")).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 2, None), (2, 0, None)}


def test_task_memory_begins_anew(spark, monkeypatch):
    monkeypatch.setattr(importance, "MOST_KNOWN", 2)
    rng = random.Random(5)
    docs = [(i, text_of(rng, 12)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance.resampled(frame, frame.select("text"), 50, 2, 50, 1, "s").collect()
    assert sorted(map(tuple, got), key=str) == resampled_brute(docs, [t for _, t in docs], 50, 2, 50, 1, "s")


# Divergence audit


def audit_brute(docs, least, ranks):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        tf[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(tf[lang, s])

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1000000000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, own = p(whole), {s: p(tf[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(own[s][t], q[t])) for t in kept if tf[lang, s][t] and own[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, ranks)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("n,first", [(0, 64), (1, 1), (150, 1), (150, 64)])
def test_audit_against_brute_force(spark, monkeypatch, n, first):
    rng = random.Random(n)
    monkeypatch.setattr(divergence, "MOST_TERMS", 7)
    monkeypatch.setattr(divergence.top_terms, "__defaults__", (first,))
    common = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["É", "漢"]
    docs = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "a", "a", "b", "c", None])
        at = rng.randrange(60)
        docs.append((lang, source, None if rng.random() < 0.1 else " ".join(rng.choices(common[at : at + 30], k=rng.randint(0, 40))).replace("wa", rng.choice(["wa", "WA"]))))
    docs += [("de", "a", "ein zwei"), ("de", "b", None), ("de", "c", "3 4")] * min(n, 1)
    frame = spark.createDataFrame([(*r, 1.0) for r in docs], "lang string, source string, text string, value double").repartition(3)
    got = divergence.audit(frame, 5, 4)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audit_brute(docs, 5, 4)


def test_probabilities_of_counts_beyond_a_long(spark):
    n, total, kept = 5 * 10**14, 9 * 10**15, 10**9
    row = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total), F.lit(kept)).alias("p"), divergence.gap(F.lit(10**9), F.lit(3)).alias("f")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * kept) and row["f"] == (10**9 - 3) ** 2 // (10**9 + 3)


# Token files


@pytest.mark.parametrize("width", range(1, 33))
def test_packing_comes_back(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype("<u4")
        data = token_files.packed(ids, width)
        assert len(data) == -(-n * width // 8) and np.array_equal(token_files.unpacked(data, width, n), ids)
    bits = "".join(f"{int(i):0{width}b}"[::-1] for i in ids)
    assert int(bits[::-1], 2).to_bytes(len(data), "little") == data
    assert np.array_equal(token_files.unpacked(data, width, 500, 13), ids[13:513])


def test_width():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537, 2**32)] == [1, 1, 2, 8, 9, 16, 16, 17, 32]


def test_chunks_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "MOST_WORDS", 300)
    whole, coder, rng = Tokenizer.from_file(path), token_files.ChunkIds(path), random.Random(3)
    texts = ["", " ", "a", "Don't we'll 3.14", "<|endoftext|>x  <|endoftext|>", "word " * 3000, "z" * 5000, "a\n\n b \n c\t\td   e　f   g", "Ġx Ġ y", "αβγ δ,ε ßa İstanbul"]
    alphabet = " \n\t \x1c\x1d\x85᠎​ abÉ漢1.'śĠ_,"
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(2000)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.of_texts(some)] == [whole.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("options", [{}, {"block": 8, "fileIds": 40, "fileDocs": 5, "vocabulary": 50258}, {"block": 9, "fileIds": 40, "vocabulary": 1 << 17}])
def test_token_files_against_brute_force(spark, tmp_path, options):
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(8)
    whole = Tokenizer.from_file(path)
    docs = [(None if i % 17 == 3 else (i * 7) % 50, text_of(rng, 20)) for i in range(90)] + [(5, "word " * 2000), (3, "same")] + [(4, "same")] * 20
    frame = spark.createDataFrame([(*r, b"x") for r in docs], "doc_id long, text string, ids binary").repartition(4)
    if options and options["block"] == 9:
        back = token_files.round_trip(frame, path, str(tmp_path / "ids"), **options)
    elif options:
        token_files.write_ids(token_files.encoded(token_files.in_order(frame), path), str(tmp_path / "ids"), **options)
        back = spark.read.format("token_ids").load(str(tmp_path / "ids"))
    else:
        back = token_files.round_trip(frame, path, f"file://{tmp_path}/ids")
    rows = token_files.digests(back).orderBy("start").collect()
    own = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 0]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((d, len(own(t)), crc(own(t))) for d, t in docs)
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == starts[:-1].tolist()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))


def test_token_files_give_ranges_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([(i, np.arange(i, i + 30, dtype="<u4").tobytes(), i) for i in range(50)], "doc_id long, ids binary, start long").coalesce(1)
    folder = str(tmp_path / "ids")
    token_files.write_ids(rows, folder, vocabulary=100, block=64)
    store, root = token_files.opened(folder)
    every = np.concatenate([np.arange(i, i + 30) for i in range(50)])
    at = 0
    for f in token_files.manifest(store, root)["files"]:
        with store.open_input_file(f"{root}/{f['name']}") as source:
            file = token_files.TokenFile(source, f["bytes"])
            assert file.width == 7
            for start, stop in ((0, 0), (0, 1), (63, 65), (5, f["ids"]), (f["ids"], f["ids"])):
                if start <= stop <= f["ids"]:
                    assert np.array_equal(file.range(start, stop), every[at + start : at + stop])
            with pytest.raises(IndexError):
                file.range(0, f["ids"] + 1)
        at += f["ids"]
    back = spark.read.format("token_ids").load(folder)
    got = back.where("doc_id = 7").select("start", token_files.as_array(F.col("ids")).alias("a")).collect()
    assert [(r["start"], r["a"]) for r in got] == [(210, list(range(7, 37)))]
    assert {r["doc_id"] for r in back.where("doc_id > 44 and doc_id <= 47").collect()} == {45, 46, 47}
    assert back.where("doc_id in (1, 2, 99)").count() == 2 and back.where("doc_id is null").count() == 0


def test_token_reader_leaves_out_files_and_checks_blocks(tmp_path):
    import json

    from pyspark.sql.datasource import EqualTo, GreaterThan

    files = []
    for k in range(3):
        with open(tmp_path / f"{k}.ids", "wb") as out:
            w = token_files.FileWriter(out, 9, 4)
            for i in range(10):
                w.add(10 * k + i, np.full(i, 300, "<u4"))
            with pytest.raises(ValueError):
                w.add(0, np.array([512], "<u4"))
            w.names.clear(), w.ends.clear()
            for i in range(10):
                w.names.append(10 * k + i), w.ends.append(i * (i + 1) // 2)
            files.append({"name": f"{k}.ids", **w.close(), "bytes": (tmp_path / f"{k}.ids").stat().st_size})
    (tmp_path / token_files.MANIFEST).write_text(json.dumps({"width": 9, "files": files}))
    reader = token_files.TokenReader({"path": str(tmp_path), "partitionbytes": "1"})
    assert len(reader.partitions()) == 3
    assert list(reader.pushFilters([EqualTo(("doc_id",), 15), GreaterThan(("start",), 3)])) == [GreaterThan(("start",), 3)]
    (part,) = reader.partitions()
    assert part.files[0][0] == "1.ids" and part.files[0][2] == 45
    (batch,) = reader.read(part)
    assert batch.to_pylist() == [{"doc_id": 15, "start": 55, "ids": np.full(5, 300, "<u4").tobytes()}]
    data = bytearray((tmp_path / "1.ids").read_bytes())
    data[20] ^= 1
    (tmp_path / "1.ids").write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        list(reader.read(part))


def test_token_files_append_overwrite_and_no_rows(spark, tmp_path):
    folder, none = str(tmp_path / "ids"), spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(none, tokenizer_path("byte_bpe_50k.json"), folder).count() == 0
    rows = lambda k: spark.createDataFrame([(k, bytes([k, 0, 0, 0]))], "doc_id long, ids binary").selectExpr("doc_id", "0L AS start", "ids")
    out = lambda k, mode, n=50257: rows(k).write.format("token_ids").option("vocabulary", n).mode(mode).save(folder)
    out(1, "append")
    out(2, "append")
    back = lambda: [(r["doc_id"], r["start"]) for r in spark.read.format("token_ids").load(folder).orderBy("start").collect()]
    assert back() == [(1, 0), (2, 1)]
    with pytest.raises(Exception, match="bits an id"):
        out(3, "append", 100)
    out(4, "overwrite")
    assert back() == [(4, 0)] and len(list((tmp_path / "ids").glob("*.ids"))) == 1
