"""The other operators against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seedloom.llm import attention, language, lz, mixing, packing, subwords, toxicity, url_filter, warc
from seedloom.llm.queries import RULES, tokenizer_path

SCHEMA = "doc_id long, text string"
ODD = ["", " ", "a", "Don't we'll 3.14", "<|endoftext|>x <|startoftext|>", "É é İstanbul\u00a0x\x1cy 漢字 \u0301a", "word " * 3000, "z" * 5000]


# Lempel-Ziv fingerprints


def lz_brute(rows):
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - ((h >> 63) << 64)
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        f, g, h = (lz.array_of(lz.fingerprint(x)) for x in (t, edited, following))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz.text_of(f), lz.text_of(g), lz.likeness(f, g), lz.likeness(f, h)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_lz_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(None if i % 13 == 5 else (7 * i) % 45, None if i % 11 == 3 else " ".join(rng.choices(["alpha", "beta é", "x", "\n"], k=rng.randint(0, 60)))) for i in range(n)]
    got = [tuple(r) for r in lz.compared_in_order(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(lz_brute(rows), key=str)


def test_lz_keeps_rows_of_large_ids_beside_null_ones(spark):
    """Parts of null ids alone don't make the other parts' first ids inexact."""
    rows = [((1 << 60) + 3 * i, f"text {i}") for i in range(40)] + [(None, "none"), (None, None)]
    got = [tuple(r) for r in lz.compared_in_order(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(lz_brute(rows), key=str)


def test_lz_phrases():
    assert lz.phrases("aababcab", set()) == (["a", "ab", "abc"], "ab")
    known = set()
    first, begun = lz.phrases("aaba", known)
    assert [*first, *lz.phrases("bcab", known, begun)[0]] == ["a", "ab", "abc"]
    assert lz.likeness(lz.array_of(""), lz.array_of("")) == 1.0 and lz.fingerprint("") == ""
    many = np.random.default_rng(0).integers(0, 2**32, 5000, dtype=np.uint32)
    assert np.array_equal(lz.smallest(many, many[:100]), np.unique(many)[: lz.KEEP])


# Packing


def test_subword_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    coder = subwords.WordIds(tokenizer_path())
    for text in ODD:
        assert np.frombuffer(coder.of_text(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:30]
    lead = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    lead.encode_special_tokens = True
    coder = subwords.WordIds(tokenizer_path("byte_bpe_50k.json"), lead=True)
    for text in ODD:
        words = text.encode().split()
        whole = " " + b" ".join(words).decode() if words else ""
        assert np.frombuffer(coder.of_words(words), "<u4").tolist() == lead.encode(whole, add_special_tokens=False).ids


def test_remembered_words_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(subwords, "MOST_WORDS", 5)
    coder = subwords.WordIds(tokenizer_path())
    fresh = subwords.WordIds(tokenizer_path())
    for text in ("one two three four", "five six seven", "one eight nine ten eleven twelve"):
        assert coder.of_text(text.encode()) == b"".join(fresh.of_text(w.encode()) for w in text.split())


def test_words_with_marks_are_as_the_tokenizer_has_them():
    from tokenizers import Tokenizer

    t, coder = Tokenizer.from_file(tokenizer_path()), subwords.WordIds(tokenizer_path())
    words = ["don't", "don't.", "x's,", "a.b", "abc,", "abc", "...", "é,", "e\u0301,", "abc\u0301.", "\u0130.", "\ufb1d.", "\u0958,", "\u212b,", "1.", "a1.", "A|>", "word'", "한국어.", "<|endoftext|>."]
    for word in words:
        assert coder.of_text(word.encode()) == np.array(t.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word


def test_best_fit():
    assert packing.best_fit([], 10) == []
    assert packing.best_fit([6, 5, 4, 5], 10) == [[0, 2], [1, 3]]
    rng = random.Random(5)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    bins = packing.best_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.03 * sum(lengths) / 100 + 1


@pytest.mark.parametrize("splits,capacity", [(1, 64), (23, 64), (90, 2048)])
def test_packing_keeps_every_token(spark, splits, capacity):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer_path()), random.Random(2)
    rows = [(i % 50 if i % 17 else None, " ".join(rng.choices(["alpha", "beta", "gamma!", "d"], k=rng.randint(0, 90)))) for i in range(200)] + [(7, t) for t in ODD] + [(8, None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(splits), tokenizer_path(), capacity).collect()
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            want[d, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(sequences) <= (1.02 if capacity == 2048 else 1.05) * least + 2


def test_best_fit_of_counts():
    rng = random.Random(6)
    for capacity, n in [(10, 40), (64, 500), (100, 3000), (7, 1)]:
        lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 3)]) for _ in range(n)]
        runs, seen, rows = packing.best_fit_runs(Counter(lengths), capacity), Counter(), {}
        ranks = []
        for x in lengths:
            ranks.append(seen[x])
            seen[x] += 1
        for x, b, o in zip(lengths, *runs.places(np.array(lengths), np.array(ranks))):
            rows.setdefault(int(b), []).append((int(o), x))
        for items in rows.values():
            ends = [0, *np.cumsum([x for _, x in sorted(items)]).tolist()]
            assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= capacity
        want = packing.best_fit(lengths, capacity)
        assert Counter(tuple(sorted(x for _, x in i)) for i in rows.values()) == Counter(tuple(sorted(lengths[i] for i in b)) for b in want)


def test_steps_of_a_node():
    rng = random.Random(8)
    for capacity, n, least in [(64, 300, 63), (64, 300, 0), (100, 2000, 95), (10, 1, 10)]:
        counts = Counter(rng.randint(1, capacity) for _ in range(n))
        done, onward, seen = {}, {}, Counter()
        for length, first, pieces, each, base, sequence, settled, next_ in packing.node_steps(counts, capacity, least):
            assert first == seen[length]  # runs of a length follow one another
            seen[length] += pieces
            for k in range(pieces):
                if settled:
                    done.setdefault(sequence + k // each, []).append((base + k % each * length, length))
                else:
                    onward.setdefault(length, []).append(next_ + k)
        assert seen == counts
        for items in done.values():
            ends = [0, *np.cumsum([x for _, x in sorted(items)]).tolist()]
            assert [o for o, _ in sorted(items)] == ends[:-1] and least <= ends[-1] <= capacity
        assert all(v == list(range(len(v))) for v in onward.values()) and (least or not onward)


@pytest.mark.parametrize("fan_in", [2, 64])
def test_packing_in_rounds(spark, monkeypatch, fan_in):
    """A third of all documents in copies of one length, of which no two fit together, over many splits and rounds."""
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(3)
    rows = [(i, "d " * (39 if i % 3 == 0 else rng.randint(0, 63))) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(9), tokenizer_path(), 64).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((i, t.count("d") + 1) for i, t in rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        ends = [0, *np.cumsum([x for _, x in sorted(items)]).tolist()]
        assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= 64
    best = len(packing.best_fit([r.length for r in got], 64))
    assert best <= len(sequences) <= 1.02 * best, (best, len(sequences))


def test_packing_meets_over_all_splits(spark, monkeypatch):
    """Documents of which no two fit together, in some splits, and short ones that fill them, in others."""
    monkeypatch.setattr(packing, "MOST_OPEN", 4, raising=False)
    rows = [(i, "d " * (39 if i < 120 else 23)) for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA).repartitionByRange(6, "doc_id")
    got = packing.pack(docs, tokenizer_path(), 64).collect()
    assert sorted(r.length for r in got) == [24] * 120 + [40] * 120
    assert len({r.sequence_id for r in got}) == 120


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


# Language


def languages(spark, n=120):
    rng = random.Random(9)
    words = {"en": ["the", "and", "thing", "with", "other"], "fr": ["les", "été", "eaux", "oui", "quelle"], "de": ["der", "und", "schön", "nicht", "ich"]}
    rows = [(i, lang := rng.choice(list(words)), " ".join(rng.choices(words[lang], k=rng.randint(3, 40)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string"), words


def test_language_of_held_out_rows(spark):
    docs, words = languages(spark)
    model = language.fitted(docs.where("doc_id % 4 <> 2"))
    got = language.predicted(docs.where("doc_id % 4 = 2").select("doc_id", "lang", "text"), model).collect()
    assert got and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    mixed = " ".join(words["en"] * 30 + words["fr"] * 15)
    lead, _, shares = language.infer(mixed.encode(), model)
    assert lead == "en" and set(shares) == {"en", "fr"} and 0.55 < shares["en"] < 0.8
    assert set(language.infer(" ".join(words["de"] * 30).encode(), model)[2]) == {"de"}


def test_language_edges(spark):
    docs, _ = languages(spark)
    model = language.fitted(docs.union(spark.createDataFrame([(1, None, "x"), (2, "en", None)], docs.schema)))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 34!"), (4, "…—"), (5, "x"), (6, "the " * 50_000), (7, "漢字")], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(rows, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and all(got[i][0] != "und" for i in (5, 6, 7))
    none = language.fitted(docs.where("false"))
    assert {r.lang_pred for r in language.predicted(rows, none).collect()} == {"und"}
    assert language.predicted(rows.where("false"), model).count() == 0


def language_brute(text, rows):
    """Leading language and its share by plain Python, from labelled (lang, text)."""

    def codes(s):
        code = lambda b: b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 32 + (b & 31) if b >= 128 else 0
        x = [0, *[code(b) for b in s.encode()], 0]
        return [tuple(x[i - 1 : i + 2]) for i in range(1, len(x) - 1) if x[i]]

    seen = {}
    for lang, s in rows:
        seen.setdefault(lang, Counter()).update(codes(s))
    names, own = sorted(seen), codes(text)
    p = {c: [(seen[z][c] + language.ALPHA) / (seen[z].total() + language.ALPHA * language.TRIGRAMS) for z in names] for c in set(own)}

    def em(which, share):
        for _ in range(language.ROUNDS):
            new = [0.0] * len(which)
            for c in own:
                parts = [share[j] * p[c][z] for j, z in enumerate(which)]
                for j, x in enumerate(parts):
                    new[j] += x / sum(parts) / len(own)
            done, share = max(abs(x - y) for x, y in zip(new, share)) < 1e-3, new
            if done:
                break
        return share

    gain = lambda which, share: sum(math.log(sum(s * p[c][z] for s, z in zip(share, which))) for c in own)
    every = em(range(len(names)), [1 / len(names)] * len(names))
    first = max(range(len(names)), key=lambda z: (gain([z], [1.0]), -z))
    chosen, best, parts = [first], gain([first], [1.0]), [1.0]
    while len(chosen) < len(names):
        tried = []
        for z in set(range(len(names))) - set(chosen):
            some = [*chosen, z]
            total = sum(max(every[k], 1e-3) for k in some)
            mixed = em(some, [max(every[k], 1e-3) / total for k in some])
            tried.append((gain(some, mixed), -z, some, mixed))
        found = max(tried)
        if found[0] - best < language.PENALTY * math.log(len(own) + 1):
            break
        best, _, chosen, parts = found
    return names[chosen[parts.index(max(parts))]], every[chosen[parts.index(max(parts))]], {names[z]: s for z, s in zip(chosen, parts)}


def test_language_against_plain_python(spark):
    docs, words = languages(spark, 60)
    rows = [(r.lang, r.text) for r in docs.collect()]
    model, rng = language.fitted(docs), random.Random(3)
    for n in range(12):
        text = " ".join(rng.choices(words["en"], k=n * 3) + rng.choices(words["fr"], k=30 - n * 2) + rng.choices(words["de"], k=n % 3 * 8) + ["Ünseen"])
        lang, score, shares = language.infer(text.encode(), model)
        want = language_brute(text, rows)
        assert lang == want[0] and abs(score - want[1]) < 1e-3 and shares.keys() == want[2].keys()
        assert all(abs(shares[k] - want[2][k]) < 1e-3 for k in shares)


def test_language_pieces_ties_repeats_and_many_languages(spark, monkeypatch):
    text = ("the quick été 漢字 fox, 12 " * 40).encode()
    whole = language.trigram_counts(text)
    for piece in (1, 7, 64, len(text) - 1):
        monkeypatch.setattr(language, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(language.trigram_counts(text), whole))
    tied = language.fitted(spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string"))
    rows = spark.createDataFrame([(1, "same", "x"), (1, "same", "x")], "doc_id long, text string, score string")
    got = language.predicted(rows, tied).collect()
    assert [r.lang_pred for r in got] == ["a", "a"] and got[0] == got[1] and abs(got[0].score - 0.5) < 1e-6
    many = language.fitted(spark.createDataFrame([(f"l{i:03}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 20) for i in range(130)], "lang string, text string"))
    assert language.infer(b"cbq cbq cbq cbq", many)[0] == "l028"


def test_a_small_share_is_told_by_the_penalty_alone(spark):
    """A hundredth of a long text is another language's: no share is too small to be selected if it gains more than the penalty."""
    docs, words = languages(spark, 60)
    model, rng = language.fitted(docs), random.Random(4)
    text = " ".join(rng.choices(words["de"], k=9900) + rng.choices(words["en"], k=100))
    lang, _, shares = language.infer(text.encode(), model)
    assert lang == "de" and set(shares) == {"de", "en"} and 0.002 < shares["en"] < 0.03
    assert set(language.infer(" ".join(rng.choices(words["de"], k=9900)).encode(), model)[2]) == {"de"}


def test_mixture_is_the_likeliest():
    likely = np.random.default_rng(1).random((400, 2)).astype(np.float32)
    share = language._mixture(likely, np.ones(len(likely), np.float32), np.full(2, 0.5, np.float32), 200)
    grid = max(np.linspace(0, 1, 2001), key=lambda p: np.log(likely @ np.array([p, 1 - p])).sum())
    assert abs(share[0] - grid) < 0.02


# Mixing


def mix_brute(rows, weights=(3, 1, 2)):
    import re

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped, level = 1.5 * sum(size), set(), 0.0
    while len(capped) < len(names):
        level = (budget - 2.0 * sum(total[s] for s in capped)) / sum(w[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and 2 * total[s] < level * w[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * total[s] if s in capped else min(2.0 * total[s], level * w[s]) for s in names}
    queue, upto = [], Counter()
    order = sorted(range(len(rows)), key=lambda i: (hashlib.md5(("" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest(), rows[i][0] is not None, rows[i][0] or 0, size[i]))
    for i in order:
        s = rows[i][1]
        upto[s] += size[i]
        for e in range(2):
            queue.append(((e * total[s] + upto[s]) / target[s] if target[s] else 0.0, order.index(i), i))
    taken, run = Counter(), 0
    for _, _, i in sorted(queue):
        run += size[i]
        if run > budget:
            break
        taken[i] += size[i]
    return sorted(((d, size[i], total[s], target[s], taken[i]) for i, (d, s, _) in enumerate(rows)), key=str), [(size[i], taken[i]) for i in range(len(rows))]


def mix_taken(rows):
    """Size and words taken of each row, in the order of ``rows``."""
    return mix_brute(rows)[1]


@pytest.mark.parametrize("n,sources", [(0, 1), (1, 1), (80, 4), (200, 9)])
def test_mix_against_brute_force(spark, n, sources):
    rng = random.Random(n)
    rows = [(None if i == 3 else i if i % 20 else 5, None if i % 10 == 1 else f"s{min(rng.randrange(sources), rng.randrange(sources))}", None if i % 15 == 2 else "w " * rng.randint(0, 30)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted([tuple(r) for r in got.collect()], key=str) == mix_brute(rows)[0]


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 7), i, "k") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, target string")
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter({r: times[r[0]] for r in rows if times[r[0]]})


@pytest.mark.parametrize("ids", [1, 3, 500])
def test_mixed_documents_against_brute_force(spark, ids):
    """Ids that many rows have, of equal and of different sizes, null ids, texts and sources: each is in the mix as often as the words that it gives."""
    rng = random.Random(ids)
    rows = [(None if i % 31 == 3 else rng.randrange(ids), rng.choice(["a", "a", "b", None]), None if i % 15 == 2 else "w " * rng.randint(0, 4), i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _row int").repartition(3)
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for (d, s, _, _), (size, taken) in zip(rows, mix_taken([r[:3] for r in rows])):
        want[d, s, size] += taken // size if size else 1
    assert got == +want


def test_ranked(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "b", "a", "é", "z")], "s string")
    assert [r.s for r in sorted(mixing.ranked(rows, F.col("s").asc_nulls_last()).collect(), key=lambda r: r["rank"])] == ["a", "b", "z", "é", None]


# WARC


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (1, "http://b/\n", "same"), (2, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 100_000), (6, "u", "x" * 100_000), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages, folder).collect()}
    assert got == {(1, "response", None, 4), (3, "revisit", 1, 4), (None, "revisit", 1, 4), (2, "response", None, 0), (4, "revisit", 2, 0), (5, "response", None, 16), (6, "response", None, 100_000)}
    whole = spark.read.format("warc").load(folder)
    texts = {warc_id: text for warc_id, text in whole.where("record_type = 'response'").select("record_id", "payload").collect()}
    assert texts["<urn:x-page:5>"] == rows[4][2] and texts["<urn:x-page:1>"] == "same"
    import base64

    digests = {r.payload_digest for r in whole.where("record_id = '<urn:x-page:6>'").collect()}
    assert digests == {"sha1:" + base64.b32encode(hashlib.sha1(b"x" * 100_000).digest()).decode()}
    assert whole.where("record_type = 'revisit' and refers_to = '<urn:x-page:1>'").count() == 2
    assert {r.record_type for r in warc.records(pages, least_bytes=1).where("payload_bytes = 0").collect()} == {"response"}


def test_warc_skips_what_filters_refuse(tmp_path):
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes([("WARC-Type", k), ("WARC-Record-ID", k)], b"\xff" * 10)) for k in ("request", "response", "metadata")))
    (tmp_path / "b.warc").write_bytes(warc.record_bytes([("warc-type", "response"), ("X", "1\r\n folded")], b"ok"))
    reader = warc.WarcReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 1)]))
    assert len(left) == 1 and isinstance(left[0], GreaterThan)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[0], r[6]) for r in sorted(rows, key=lambda r: r[6])] == [("response", 2), ("response", 10)]


def test_warc_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string")
    (tmp_path / "none").mkdir()
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none").count() == 0


# Toxicity


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(4)
    plain, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["zorgich", "zorgung", "zorgheit", "blarfa", "blarfo"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 7 == 0
        words = rng.choices(plain, k=30) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(docs.where("doc_id % 5 <> 0"), marks.where("doc_id % 5 <> 0"))
    got = {r.doc_id: (r.predicted, r.score) for r in toxicity.scored(docs.where("doc_id % 5 = 0"), model).collect()}
    assert all(got[i][0] == int(i % 7 == 0) and 0 <= got[i][1] <= 1 for i in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "wordaa " * 100_000), (4, "you idiot, you stupid moron, you pathetic loser")], SCHEMA)
    got = {r.doc_id: r.predicted for r in toxicity.scored(odd, model).collect()}
    assert got[1] == got[2] == got[3] == 0
    assert toxicity.scored(odd.where("false"), model).count() == 0
    empty = toxicity.fitted(docs.where("false"), marks.where("false"))
    assert toxicity.scored(odd, empty).count() == 4


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    good, copy_ = (rng.random(4000) < np.where(truth, 0.8, 0.01)) * 1.0, None
    copy_, weak = good.copy(), (rng.random(4000) < np.where(truth, 0.5, 0.3)) * 1.0
    other = (rng.random(4000) < np.where(truth, 0.7, 0.02)) * 1.0
    votes = np.stack([good, copy_, weak, other], axis=1).astype(np.float32)
    known = np.where(rng.random(4000) < 0.3, truth, -1).astype(float)
    q, fit = toxicity.label_model(votes, np.ones(4000), known)
    assert fit["weight"][0] < 0.7 < fit["weight"][3] and fit["on"][0] / fit["off"][0] > fit["on"][2] / fit["off"][2]
    assert ((q > 0.5) == truth).mean() > 0.93


# URLs


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x", "https://example.org/en/12", "x://example.com/de/", "x://com", "ftp://badexample.org/es/#a", "http://h?q#/z", "a://b://c/d", "http://www.example.com/fr/8"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, item long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame([], "item long, bad int"), RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("com/de/", "block") and got[6] == ("com", "", None, "allow")
    assert got[7] == ("badexample.org", "/es/", "org/", "allow") and got[8][:2] == ("h", "") and got[9][:2] == ("b:", "//c/d")
    assert got[10][2:] == ("com/fr/", "allow")
    assert url_filter.judge(pages.where("false"), spark.createDataFrame([], "item long, bad int"), RULES).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.spam.net", 200, 190), ("new.spam.net", 0, 0), ("good.org", 300, 3), ("one.org", 1, 1), ("fine.com", 50, 1)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    assert got["bad.spam.net"].bound > got["new.spam.net"].bound > 0.5 > got["fine.com"].rate
    assert got["one.org"].bound < 0.5 and all(r.bound <= r.rate for r in got.values())
    pages = spark.createDataFrame([(i, "http://bad.spam.net/1" if i < 60 else "http://ok.org/", i) for i in range(120)], "page_id long, url string, item long")
    marks = spark.createDataFrame([(i, int(i < 55)) for i in range(100)] + [(1, None), (None, 1)], "item long, bad int")
    got = url_filter.judge(pages, marks, ()).groupBy("host").agg(F.collect_set("verdict").alias("v")).collect()
    assert {r.host: r.v for r in got} == {"bad.spam.net": ["block"], "ok.org": ["allow"]}


def test_suffixes(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("x",), ("",)], "h string")
    got = [tuple(r) for r in hosts.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.com", "com"), ("x", "x"), ("", "")]


# Language model


def lm_rows(n=60):
    rng = random.Random(8)
    words = ["the", "thing", "other", "with", "là", "X9"]
    return [(i, i % 7 == 2, None if i == 9 else " ".join(rng.choices(words, k=rng.randint(0, 120)))) for i in range(n)] + [(99, True, "neverseen " * 3)]


def test_lm_counts_and_base_scores(spark, monkeypatch):
    monkeypatch.setattr(attention, "TOP_WORDS", 3)
    monkeypatch.setattr(attention, "ROUNDS", 1)
    rows = lm_rows()
    got = attention.scored(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), tokenizer_path("byte_bpe_50k.json")).collect()
    tokens = lambda t: [*(t or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).split(), None]
    c = Counter(w for _, held, t in rows if not held for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {d: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, _, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and abs(r.base_score - want[r.doc_id][3]) < 1e-6
        assert r.score < 0 and math.isfinite(r.score)


def test_lm_slots_and_successors_cover_all_rows(spark, monkeypatch):
    """However few windows are sampled to train on."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "zyzzyva", "on", "mats"], k=rng.randint(0, 90)))) for i in range(40)] + [(40, None)]
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(attention, "SHARD", 1)
    monkeypatch.setattr(attention, "trained", lambda m, sample: m.p)
    model = attention.fitted(docs, attention.word_counts(docs), tokenizer, sum(len((t or "").split()) + 1 for _, t in rows))
    coder = subwords.word_ids(tokenizer, lead=True)
    texts = [[*np.frombuffer(coder.of_words((t or "").encode().split()), "<u4").tolist(), attention.END] for _, t in rows]
    n = Counter(i for t in texts for i in t)
    common = [attention.END] + sorted(n.keys() - {attention.END}, key=lambda i: (-n[i], i))
    assert [int(model.slot[i]) for i in common] == list(range(len(common)))
    pairs = np.zeros((attention.SLOTS, attention.SLOTS))
    for t in texts:
        for x, y in zip([attention.END, *t], t):
            pairs[model.slot[x], model.slot[y]] += 1
    ids = np.array([n[i] for i in range(attention.VOCABULARY)], float)
    whole = attention.fresh(model.slot, ids, pairs)
    assert np.allclose(model.direct, whole.direct) and np.allclose(model.direct_group, whole.direct_group) and np.allclose(model.rare, whole.rare)


def test_lm_trains_on_every_window(spark, monkeypatch):
    """Of a corpus of many shards, too, each window is a shard's, and the rounds read one part after another."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "zyzzyva", "on", "mats"], k=rng.randint(0, 190)))) for i in range(40)] + [(40, None)]
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(attention, "SHARD", 5)
    tokens = sum(len((t or "").split()) + 1 for _, t in rows)
    got = attention.training_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), tokenizer, tokens).collect()
    coder = subwords.word_ids(tokenizer, lead=True)
    lengths = [len(coder.of_words((t or "").encode().split())) // 4 + 1 for _, t in rows]
    assert len(got) == sum(-(-n // attention.STEP) for n in lengths) and {r.part for r in got} == set(range(attention.ROUNDS))
    m, _ = small_model()
    monkeypatch.setattr(attention, "ROUNDS", 2)
    sample = [(k % 2, 0, [int(x) for x in np.random.default_rng(k).integers(0, 40, attention.WINDOW + 1)]) for k in range(6)]
    found = attention.trained(m, spark.createDataFrame(sample, "part int, shard int, ids array<int>").repartition(2))
    state = attention.started(m.p)
    for number in range(2):
        own = np.array(sorted(ids for part, _, ids in sample if part == number), np.int64)
        state, _ = attention.one_round(m, state, *attention.targets(own, m.slot), number, 2)
    for name, value in attention.parameters(state).items():
        assert np.allclose(found[name], value, atol=1e-5)


def test_lm_encodes_texts_once_and_shards_hold_what_they_say(spark, monkeypatch):
    """However many subwords a word has; and training reads ids alone."""
    rng = random.Random(3)
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, " ".join("".join(rng.choices("bcdfgzxq", k=20)) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seen = []
    monkeypatch.setattr(attention, "SHARD", 40)
    monkeypatch.setattr(attention, "trained", lambda m, sample: seen.append(sample.groupBy("part", "shard").count().collect()) or m.p)
    ids = attention.coded(docs, tokenizer)
    assert ids.columns == ["doc_id", "ids"]
    attention.fitted(ids, attention.word_counts(docs), tokenizer, 61 * 40)
    (shards,) = seen
    coder = subwords.word_ids(tokenizer, lead=True)
    windows = sum(-(-(len(coder.of_words(t.encode().split())) // 4 + 1) // attention.STEP) for _, t in rows)
    assert sum(r["count"] for r in shards) == windows and {r.part for r in shards} == set(range(attention.ROUNDS))
    assert 20 < windows / len(shards) < 60


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    slot = np.full(attention.VOCABULARY, attention.OTHER, np.int16)
    slot[:40], slot[attention.END] = np.arange(40), 40
    pairs = np.zeros((attention.SLOTS, attention.SLOTS))
    pairs[:41, :41] = rng.integers(0, 5, (41, 41))
    return attention.fresh(slot, np.ones(attention.VOCABULARY), pairs), rng


def test_windows_score_each_place_once():
    lengths = np.array([1, 5, 48, 49, 64, 65, 200])
    own, places, real, scored = attention.windows(lengths)
    start = np.cumsum(lengths) - lengths
    seen = Counter()
    for o, place, r, s in zip(own, places, real, scored):
        for k in np.nonzero(s)[0]:
            at = int(place[attention.OVERLAP + k] - start[o])
            seen[int(o), at] += 1
            assert min(at, attention.OVERLAP) <= r[: attention.OVERLAP + k].sum()
    assert seen == Counter({(i, k): 1 for i, n in enumerate(lengths) for k in range(n)})


def test_model_is_a_distribution_and_causal():
    m, rng = small_model()
    m.settled()
    x = rng.integers(0, 41, (1, attention.WINDOW))
    a = m.attended(x)[0]
    every = np.arange(attention.SLOTS)
    for t in (0, 7, 31):
        lp = m.log_probability(np.repeat(a[t : t + 1], attention.SLOTS, axis=0), np.full(attention.SLOTS, x[0, t]), every)
        assert abs(np.exp(lp).sum() - 1) < 1e-4
    later = x.copy()
    later[0, attention.OVERLAP + 20 :] = 0
    assert np.allclose(m.attended(later)[0, :20], a[:20], atol=1e-6)
    assert abs(np.exp(m.rare[m.slot == attention.OTHER]).sum() - 1) < 1e-6


def lm_brute(m, ids):
    """Natural logarithm of a text's probability, one place after another in plain Python, from the parameters of a model that isn't settled."""
    heads, key, value, p = attention.HEADS, attention.KEY, attention.VALUE, {k: v.astype(float).tolist() for k, v in m.p.items()}
    slots = [int(m.slot[attention.END]), *[int(m.slot[i]) for i in ids], int(m.slot[attention.END])]
    total = 0.0
    for t, target in enumerate(slots[1:]):
        first = max(0, t // attention.STEP * attention.STEP - attention.OVERLAP)  # where the window begins that scores t
        out = []
        for h in range(heads):
            q = p["q"][slots[t]][h * key : (h + 1) * key]
            weights = [math.exp(sum(a * b for a, b in zip(q, p["k"][slots[j]][h * key : (h + 1) * key])) + p["r"][h][t - j]) for j in range(first, t + 1)]
            for c in range(value):
                out.append(sum(w * p["v"][slots[j]][h * value + c] for w, j in zip(weights, range(first, t + 1))) / sum(weights))
        group = [sum(a * p["wg"][c][g] for c, a in enumerate(out)) + p["cg"][0] * float(m.direct_group[slots[t], g]) for g in range(attention.GROUPS)]
        own = target // attention.MEMBERS
        member = [sum(a * p["wm"][own][c][k] for c, a in enumerate(out)) + p["cm"][0] * float(m.direct[own, slots[t], k]) for k in range(attention.MEMBERS)]
        total += group[own] - math.log(sum(map(math.exp, group))) + member[target % attention.MEMBERS] - math.log(sum(map(math.exp, member)))
        total += float(m.rare[ids[t]]) if target == attention.OTHER else 0.0
    return total


def test_lm_scores_against_a_plain_forward_pass():
    m, rng = small_model(4)
    m.p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.p.items()}
    texts = [rng.integers(0, 60, n).astype("<u4") for n in (0, 1, 47, 48, 49, 70, 130)]
    want = [lm_brute(m, [int(i) for i in t]) for t in texts]
    assert np.allclose(m.settled().scores(texts, chunk=2), want, rtol=1e-4)


def test_batches_don_t_change_scores():
    m, rng = small_model(3)
    m.settled()
    texts = [rng.integers(0, 60, n).astype("<u4") for n in (0, 1, 30, 31, 32, 100, 333)]
    together = m.scores(texts, chunk=3)
    assert np.allclose(together, [m.scores([t])[0] for t in texts], rtol=1e-5)


def test_gradient():
    m, rng = small_model(1)
    x, y = rng.integers(0, 41, (3, attention.WINDOW)), rng.integers(0, 41, (3, attention.STEP))
    y[rng.random(y.shape) < 0.2] = attention.GONE
    x[0, :9], x[1, 60:] = attention.GONE, attention.GONE
    y[1, 60 - attention.OVERLAP :] = attention.GONE
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, grad = attention._gradient(m, x, y)
    for name, value in m.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name in "qkv":
                at = (int(rng.choice(x.ravel())), at[1])
            old, e = value[at], 1e-4
            value[at] = old + e
            up, _ = attention._gradient(m, x, y)
            value[at] = old - e
            down, _ = attention._gradient(m, x, y)
            value[at] = old
            assert abs((up - down) / (2 * e) - grad[name][at]) < 1e-4 + 0.01 * abs(grad[name][at]), name


def test_training_learns_what_is_far():
    """A token that depends on one three places before is beyond the direct path."""
    m, rng = small_model(2)
    x = rng.integers(0, 10, (600, attention.WINDOW + 1))
    for t in range(3, attention.WINDOW + 1):
        x[:, t] = (x[:, t - 3] + 1) % 10
    state, losses = attention.started(m.p), []
    for number in range(15):
        state, loss = attention.one_round(m, state, x[:, :-1], x[:, 1 + attention.OVERLAP :], number, 15)
        losses.append(loss)
    assert losses[-1] < 0.6 * losses[0]


def test_lm_shards_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(attention, "ROUNDS", 1)
    m, rng = small_model(5)
    rows = [(s, [attention.VOCABULARY] * attention.OVERLAP + [attention.END] + rng.integers(0, 40, attention.STEP).tolist()) for s in (0, 0, 1)]
    got = attention.trained(m, spark.createDataFrame(rows, "shard int, ids array<int>").repartition(3))
    ends = []
    for s in (0, 1):
        x, y = attention.targets(np.array(sorted(r for own, r in rows if own == s)), m.slot)
        ends.append(attention.parameters(attention.one_round(m, attention.started(m.p), x, y, 0, 1)[0]))
    for k in got:
        assert np.allclose(got[k], (ends[0][k] + ends[1][k]) / 2, atol=1e-6), k


def test_lm_long_words_repeated_rows_and_no_rows(spark, monkeypatch):
    """Long words are met by their digest, and have the same counts and scores whether common or not; rows that repeat score alike."""
    monkeypatch.setattr(attention, "ROUNDS", 1)
    long, other = "z" * 5000, "y" * 300
    rows = [(1, False, f"{long} a {long} b"), (1, False, f"{long} a {long} b"), (2, False, f"a {other}"), (3, True, f"{long} {other} {'x' * 400} a")]
    frame = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    seen = []
    for most in (2, 100):
        monkeypatch.setattr(attention, "TOP_WORDS", most)
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in attention.scored(frame, path).collect())
        assert got[0] == got[1] and len(got) == 4
        seen.append(got)
    assert seen[0] == seen[1] and seen[0][3][1:4] == (5, 4, 13)
    assert attention.scored(frame.where("false"), path).count() == 0


def test_lm_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, True, "a b"), (2, None, None)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in attention.scored(rows, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[2].n_tokens == 1 and got[1].train_tokens == 0


# Edges that several operators share


def test_toxicity_limit_has_the_best_measure():
    rng = np.random.default_rng(2)
    for _ in range(30):
        z = np.round(rng.normal(0, 2, 12), 1)
        n, = rng.integers(0, 5, (1, 12)).astype(float)
        bad = np.minimum(n, rng.integers(0, 5, 12))
        measure = lambda limit: 1.5 * bad[z >= limit].sum() / (n[z >= limit].sum() + 0.5 * bad.sum())  # noqa: B023, E731
        if bad.sum():
            assert abs(measure(toxicity.calibrated(z, n, bad)) - max(measure(x) for x in z)) < 1e-12
    assert toxicity.calibrated(np.ones(3), np.ones(3), np.zeros(3)) == 0


def test_toxicity_scores_against_plain_python(spark):
    voters = toxicity.Voters({"bad": 0, "idiot": 1}, [{"zorg": 2}, {}, {}, {}], (r"(?i)\bshut up\b",))
    weights = [1.5, -0.5, 2.0, 0.25, 0.75]
    model = toxicity.Classifier(voters, np.array(weights), -1.0)
    texts = ["Bad bad day", "zorgich zorg IDIOT", "you Shut Up, zorgung bad", "", None, "zorg"]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*texts, *texts])], "doc_id long, text string, predicted int")
    got = {}
    for r in toxicity.scored(rows, model).collect():
        got.setdefault(r.doc_id % 6, set()).add((round(r.score, 9), r.predicted))
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        votes = [k for k, on in enumerate(["bad" in words, "idiot" in words, any(w.startswith("zorg") and len(w) > 4 for w in words), "shut up" in (t or "").lower()]) if on]
        p = 1 / (1 + math.exp(-(sum(weights[k] for k in votes) + weights[4] * math.log1p(len(votes)) - 1.0)))
        assert got[i] == {(round(p, 9), int(p >= 0.5))}


def test_many_rules_are_joined(spark, monkeypatch):
    urls = ["http://a.example.org/en/1/x", "http://example.org/en/1?q", "http://b.org/z", "http://x.com/de/2", "nothing", None, "http://a.example.org/en/1/x"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, item long")
    outcomes = spark.createDataFrame([], "item long, bad int")
    few = sorted(map(repr, url_filter.judge(pages, outcomes, RULES).collect()))
    monkeypatch.setattr(url_filter, "MOST_RULES", 1)
    assert sorted(map(repr, url_filter.judge(pages, outcomes, RULES).collect())) == few


def test_url_reputation_blocks_in_the_query(spark, tmp_path):
    from seedloom.llm.queries import op10_url_filter

    bad = [(i, f"http://bad.net/p/{i}", "") for i in range(30)] + [(99, "http://bad.net/other", "")]
    good = [(100 + i, f"http://good.net/p/{100 + i}", "") for i in range(30)]
    spark.createDataFrame(bad + good, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    marks = [(i, 0, 0) for i in range(30)] + [(100 + i, 1, 0) for i in range(30)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: r for r in op10_url_filter(spark, str(tmp_path)).collect()}
    assert all((got[i].verdict, got[i].rule) == ("block" if i < 100 else "allow", None) for i in got)
    assert got[99].rate > got[99].bound > 0.5 > got[100].rate


def test_warc_malformed_verified_and_overwritten(spark, tmp_path):
    warc.registered(spark)
    pages = spark.createDataFrame([(1, "u1", "one"), (2, "u2", "two two"), (3, "u3", None)], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    for _ in range(2):
        warc.records(pages.coalesce(1)).write.format("warc").option("compression", "none").mode("overwrite").save(folder)
    read = lambda **o: spark.read.format("warc").options(**o).load(folder)
    assert read(verify="true").count() == 3
    (path,) = (tmp_path / "w").glob("*.warc")
    data = path.read_bytes()
    path.write_bytes(data.replace(b"two two", b"two twx"))
    with pytest.raises(Exception, match="differs from its digest"):
        read(verify="true").collect()
    assert read(verify="true", malformed="skip").count() == 1 and read().count() == 3
    path.write_bytes(data[: data.index(b"two two") + 3])
    with pytest.raises(Exception, match="ends early"):
        read().collect()
    assert [r.payload for r in read(malformed="skip").collect()] == ["one"]
    path.write_bytes(data.replace(b"Content-Length: 7", b"Content-Length: x"))
    with pytest.raises(Exception, match="invalid literal"):
        read().collect()
