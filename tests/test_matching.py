"""Seeds, matching and alignment against plain loops over small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom.operators import align, select, stats
from seedloom.operators import match as m
from seedloom.operators.seeds import Mask, in_exons, key_frequency, key_text, read_index, read_keys, seeds, write_index
from seedloom.plans.workflow import align_reads

TURN = str.maketrans("acgtACGT", "tgcaTGCA")


def turned(s):
    return s.translate(TURN)[::-1]


def genome(n, seed=1):
    return "".join(random.Random(seed).choices("acgt", k=n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "contig long, seq string")


def reads_frame(spark, rows):
    return spark.createDataFrame(rows, "read_id long, end_no int, seq string")


def test_mask_rules():
    assert Mask("1101", 1, 2).size == 3
    for bad in ("", "011", "110", "12"):
        with pytest.raises(ValueError):
            Mask(bad)
    with pytest.raises(ValueError):
        Mask("101", 1, 2)
    assert Mask("110111").truncated(3).text == "1101"
    assert Mask("110111").truncated(9).text == "110111"


@pytest.mark.parametrize("repeats", [False, True])
def test_seeds_are_those_of_a_loop(spark, repeats):
    mask, seqs = Mask("1101"), {1: "ACGTNacgtACGGT", 2: "AC", 3: "", 4: "acgNNgta"}
    want = set()
    for c, s in seqs.items():
        for i in range(len(s) - 3):
            key = s[i] + s[i + 1] + s[i + 3]
            if "N" not in key and not (repeats and key != key.upper()):
                want.add((c, i + 1, key.lower()))
    got = seeds(frame(spark, list(seqs.items())), mask, repeats).select("contig", "pos", key_text(F.col("key"), 3).alias("k"))
    assert {tuple(r) for r in got.collect()} == want


def test_null_and_short_reads_have_no_keys(spark):
    assert read_keys(reads_frame(spark, [(1, 1, None), (2, 1, "ac"), (3, 1, "")]), Mask("1111")).count() == 0


def brute_cals(refs, reads, mask, k):
    width, ones = mask.width, mask.places
    index = {}
    for c, s in refs.items():
        for i in range(len(s) - width + 1):
            index.setdefault("".join(s[i + p] for p in ones), []).append((c, i + 1))
    out = {}
    for r, s in reads.items():
        for o in range(len(s) - width + 1):
            w = s[o : o + width]
            hits = [(st, x) for st, t in (("+", w), ("-", turned(w))) for x in index.get("".join(t[p] for p in ones), [])]
            if 0 < len(hits) <= k:
                for st, (c, p) in hits:
                    at = p - o if st == "+" else p + width + o - len(s)
                    out.setdefault((r, c, at, st), set()).add(o)
    return out


def test_match_is_that_of_a_loop(spark):
    mask = Mask("1101011")
    refs = {1: genome(400, 1), 2: genome(300, 2), 3: genome(60, 1)}
    rows = {i: (refs[1] if i % 2 else turned(refs[2]))[7 * i : 7 * i + 40] for i in range(12)}
    index = seeds(frame(spark, list(refs.items())), mask)
    cals, ends = m.match(reads_frame(spark, [(i, 1, s) for i, s in rows.items()]), index, key_frequency(index), mask, m.MatchOptions(max_key_matches=3))
    got = {(r.read_id, r.contig, r.position, r.strand): set(r.offsets) for r in cals.collect()}
    assert got == brute_cals(refs, rows, mask, 3)
    assert {r.read_id for r in ends.collect()} == set(rows)


def test_strands_mirror(spark):
    """The reverse complement of all reads gives the same places on the other strand."""
    mask, ref = Mask("110111"), genome(500, 5)
    index = seeds(frame(spark, [(1, ref)]), mask)
    rows = [(i, 1, ref[20 * i : 20 * i + 30]) for i in range(20)]
    one, _ = m.match(reads_frame(spark, rows), index, key_frequency(index), mask)
    two, _ = m.match(reads_frame(spark, [(i, e, turned(s)) for i, e, s in rows]), index, key_frequency(index), mask)
    swap = {"+": "-", "-": "+"}
    assert {(r.read_id, r.position, r.strand) for r in one.collect()} == {(r.read_id, r.position, swap[r.strand]) for r in two.collect()}


def test_cap_and_flags(spark):
    mask = Mask("1111")
    index = seeds(frame(spark, [(1, "acgtacgtacgt" * 3)]), mask)
    reads = reads_frame(spark, [(1, 1, "acgtacgt")])
    cals, ends = m.match(reads, index, key_frequency(index), mask, m.MatchOptions(max_key_matches=1000, max_matches=2))
    assert cals.count() == 0 and ends.first().max_reached == -1
    cals, ends = m.match(reads, index, key_frequency(index), mask, m.MatchOptions(max_key_matches=1, key_miss_fraction=0.5))
    assert ends.first().max_reached == -1


def test_index_round_trip(spark, tmp_path):
    mask = Mask("11011", depth=1, hash_width=2)
    index = seeds(frame(spark, [(1, genome(300))]), mask)
    write_index(index, mask, str(tmp_path / "i"))
    back, frequency, same = read_index(spark, str(tmp_path / "i"))
    assert same == mask and {tuple(r) for r in back.select("contig", "pos", "key").collect()} == {tuple(r) for r in index.collect()}
    assert frequency.agg({"n": "sum"}).first()[0] == index.count()


def test_exons_hold_whole_windows(spark):
    mask = Mask("111")
    index = seeds(frame(spark, [(1, genome(50))]), mask)
    exons = spark.createDataFrame([(1, 5, 9), (1, 20, 21)], "contig long, start int, end int")
    assert {r.pos for r in in_exons(index, mask, exons).collect()} == {5, 6, 7}


def gotoh(read, ref, s):
    """A textbook affine alignment: the whole read, anywhere in the reference; a gap may not begin the reference's side."""
    low = -(10**9)
    n, k = len(read), len(ref)
    best = [[0] * (k + 1)] + [[low] * (k + 1) for _ in range(n)]
    h = [[low] * (k + 1) for _ in range(n + 1)]
    v = [[low] * (k + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = v[i][0] = s.gap_open + s.gap_extend * (i - 1)
        for j in range(1, k + 1):
            h[i][j] = max(h[i][j - 1] + s.gap_extend, best[i][j - 1] + s.gap_open)
            v[i][j] = max(v[i - 1][j] + s.gap_extend, best[i - 1][j] + s.gap_open)
            d = best[i - 1][j - 1] + (s.nt_match if read[i - 1] == ref[j - 1] else s.nt_mismatch)
            best[i][j] = max(d, h[i][j], v[i][j])
    return max(best[n])


def rescored(a, r, s):
    total, gap = 0, None
    for x, y in zip(a, r):
        kind = "d" if x == "-" else "i" if y == "-" else None
        if kind:
            total += s.gap_extend if gap == kind else s.gap_open
        else:
            total += s.nt_match if x == y else s.nt_mismatch
        gap = kind
    return total


def test_gapped_kernel_is_the_textbook_one():
    rng, s = random.Random(4), align.Scoring()
    for _ in range(60):
        ref = genome(rng.randint(12, 40), rng.random())
        at = rng.randint(0, 5)
        read = list(ref[at : at + rng.randint(4, 20)])
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(read))
            if rng.random() < 0.4 and len(read) > 2:
                del read[p]
            elif rng.random() < 0.5:
                read.insert(p, rng.choice("acgt"))
            else:
                read[p] = rng.choice("acgt")
        read = "".join(read)
        ((score, start, a, r),) = align.gapped([read], [ref], s)
        assert score == gotoh(read, ref, s) == rescored(a, r, s)
        assert a.replace("-", "") == read and ref[start:].startswith(r.replace("-", ""))
        mask = "".join(rng.choice("01") for _ in read)
        c = align.gapped_constrained([read], [ref], mask.find("1"), mask.rfind("1"), at, s)[0]
        assert c[0] <= score and c[2].replace("-", "") == read and rescored(c[2], c[3], s) <= score


def test_ungapped_kernel():
    s = align.Scoring()
    assert align.ungapped("acgt", "ttacgttt", None, 0, s) == (200, 2)
    assert align.ungapped("acga", "ttacgttt", "0001", 0, s) is None
    assert align.ungapped("acga", "ttacgttt", None, 0, s) == (0, 2)
    assert align.ungapped("acgt", "acg", None, 0, s) is None


def test_color_kernel_reads_through_an_error():
    s, ref = align.Scoring(), "ttacgtacgga"
    colors = align.colors_of(align.codes_of(ref[2:9]))
    text = "".join(map(str, colors))
    assert align.ungapped_color(text, ref, None, 0, s) == (350, 2, "ACGTACG")
    wrong = text[:3] + str((int(text[3]) + 1) % 4) + text[4:]
    score, start, bases = align.ungapped_color(wrong, ref, None, 0, s)
    assert (score, start, bases) == (350 - 125, 2, "ACGTACG")


def brute_color(colors, window, s):
    from itertools import product

    best = None
    for start in range(len(window) - len(colors) + 1):
        for bases in product(range(4), repeat=len(colors)):
            seen = align.colors_of(np.array(bases))
            total = sum(s.color_match if str(a) == b else s.color_mismatch for a, b in zip(seen, colors))
            total += sum(s.nt_match if a == b else s.nt_mismatch for a, b in zip(bases, align.codes_of(window[start : start + len(colors)])))
            best = total if best is None else max(best, total)
    return best


def test_color_kernel_against_all_readings():
    rng, s = random.Random(2), align.Scoring()
    for _ in range(15):
        window, colors = genome(7, rng.random()), "".join(rng.choices("0123", k=4))
        assert align.ungapped_color(colors, window, None, 0, s)[0] == brute_color(colors, window, s)


def brute_gapped_color(colors, window, s):
    """The best score over all readings of the colours, each aligned as bases by the textbook."""
    from itertools import product

    plain, best = align.Scoring(), None
    for bases in product(range(4), repeat=len(colors)):
        paid = sum(s.color_match if str(a) == b else s.color_mismatch for a, b in zip(align.colors_of(np.array(bases)), colors))
        total = paid + gotoh("".join("acgt"[b] for b in bases), window, plain)
        best = total if best is None else max(best, total)
    return best


def test_gapped_color_kernel_against_all_readings():
    rng, s = random.Random(6), align.Scoring()
    for _ in range(25):
        window = genome(rng.randint(5, 9), rng.random())
        bases = list(align.codes_of(window[1:]))
        if rng.random() < 0.5 and len(bases) > 3:
            del bases[2]
        colors = "".join(map(str, align.colors_of(np.array(bases[:5]))))
        colors = colors[:-1] + rng.choice("0123")
        score, start, a, r = align.gapped_color(colors, window, s)
        assert score == brute_gapped_color(colors, window, s)
        read = a.replace("-", "")
        paid = sum(s.color_match if str(x) == y else s.color_mismatch for x, y in zip(align.colors_of(align.codes_of(read)), colors))
        assert paid + rescored(a.lower(), r, s) == score and window[start:].startswith(r.replace("-", ""))


def brute_bound(colors, window, mask, offset, s):
    """The best score over all readings whose colours at the mask's inner 1s are those read: up to the first 1 and from the last one aligned freely, along the diagonal between."""
    from itertools import product

    first, last, best, n = mask.find("1"), mask.rfind("1"), None, len(colors)
    w = align.codes_of(window)
    for bases in product(range(4), repeat=n):
        seen = align.colors_of(np.array(bases))
        if any(mask[i] == "1" and str(seen[i]) != colors[i] for i in range(first, last)):
            continue
        paid = sum(s.color_match if str(a) == b else s.color_mismatch for a, b in zip(seen, colors))
        middle = sum(s.nt_match if bases[i] == w[offset + i] else s.nt_mismatch for i in range(first, last))
        text = "".join("acgt"[b] for b in bases)
        head = ended(text[:first], window[: offset + first], s, True) if first else 0
        tail = max(ended(text[last:], window[offset + last : end], s, False) for end in range(offset + last + 1, len(window) + 1))
        total = paid + middle + head + tail
        best = total if best is None else max(best, total)
    return best


def ended(read, ref, s, free):
    """The best score of the whole read that ends with the reference's last base; it begins at its first, or (``free``) anywhere."""
    from functools import cache

    @cache
    def f(i, j, state):
        if i == 0 and (free or j == 0) and state == "s":
            return 0
        options = [-(1 << 20)]
        if state == "s":
            if i and j:
                options.append(f(i - 1, j - 1, "s") + (s.nt_match if read[i - 1] == ref[j - 1] else s.nt_mismatch))
            options += [f(i, j, "h"), f(i, j, "v")]
        elif state == "h" and j:
            options += [f(i, j - 1, "h") + s.gap_extend, f(i, j - 1, "s") + s.gap_open]
        elif state == "v" and i:
            options += [f(i - 1, j, "v") + s.gap_extend, f(i - 1, j, "s") + s.gap_open]
        return max(options)

    return f(len(read), len(ref), "s")


def test_bound_gapped_color_kernel_against_all_readings():
    rng, s = random.Random(7), align.Scoring()
    for _ in range(20):
        window = genome(rng.randint(6, 10), rng.random())
        n, offset = rng.randint(3, 5), rng.randint(0, 2)
        bases = list(align.codes_of(window[offset : offset + n + 1]))
        if rng.random() < 0.5:
            del bases[rng.randrange(len(bases))]
        colors = "".join(map(str, align.colors_of(np.array(bases[:n]))))
        n = len(colors)
        masks = ["".join(rng.choice("01") for _ in range(n)) for _ in range(3)]
        at = rng.randrange(n), rng.randrange(n)
        first, last = min(at), max(at)
        masks = ["0" * first + "1" + m[first + 1 : last] + ("1" if last > first else "") + "0" * (n - last - 1) for m in masks]
        if offset + last >= len(window):
            continue
        got = align.gapped_color_constrained([colors] * 3, [window] * 3, masks, first, last, offset, s)
        for mask, (score, start, a, r) in zip(masks, got):
            want = brute_bound(colors, window, mask, offset, s)
            assert score == want if want is not None and want > -10000 else score < -10000
            read = a.replace("-", "")
            if score > -10000:
                paid = sum(s.color_match if str(x) == y else s.color_mismatch for x, y in zip(align.colors_of(align.codes_of(read)), colors))
                assert paid + rescored(a.lower(), r, s) == score and window[start:].startswith(r.replace("-", "")) and len(read) == n
    assert align.gapped_color_constrained(["0123"], ["acgtacg"], ["0000"], -1, -1, 0, s) == [align.gapped_color("0123", "acgtacg", s)]


def test_batches_of_one_shape_are_those_of_single_reads():
    rng, s = random.Random(9), align.Scoring()
    reads, windows = ["".join(rng.choices("acgt", k=6)) for _ in range(20)], ["".join(rng.choices("acgtn", k=11)) for _ in range(20)]
    colors = ["".join(rng.choices("01234", k=6)) for _ in range(20)]
    masks = ["".join(rng.choices("01", [3, 1], k=6)) for _ in range(20)]
    for own in (None, masks):
        for offset in (0, 2, 5):
            assert align.ungapped_batch(reads, windows, own, offset, s) == [align.ungapped(r, w, own and own[i], offset, s) for i, (r, w) in enumerate(zip(reads, windows))]
            assert align.ungapped_color_batch(colors, windows, own, offset, s) == [align.ungapped_color(c, w, own and own[i], offset, s) for i, (c, w) in enumerate(zip(colors, windows))]
    assert align.gapped_color_batch(colors, windows, s) == [align.gapped_color(c, w, s) for c, w in zip(colors, windows)]


def test_reads_find_their_place(spark):
    ref = {1: genome(3000, 11), 2: genome(2000, 12)}
    places = [(1, 100, "+"), (1, 2000, "-"), (2, 1, "+"), (2, 1950, "-")]
    rows = []
    for i, (c, p, st) in enumerate(places):
        seq = ref[c][p - 1 : p + 49]
        if i == 0:
            seq = seq[:25] + seq[27:]  # a deletion
        rows.append((i, 1, seq if st == "+" else turned(seq)))
    found = align_reads(reads_frame(spark, rows), frame(spark, list(ref.items())), Mask("1111111111"), constrained=False, offset=10, chunk=1500)
    got = {r.read_id: (r.contig, r.position, r.strand) for r in found.collect()}
    assert got == dict(enumerate(places))


def test_scoring_rules():
    assert align.Scoring.parse("-175 -50 50 -150") == align.Scoring()
    for bad in ("-10 -50 50 -150", "-300 -200 50 -150", "1 2 3", "5 -50 50 -150"):
        with pytest.raises(ValueError):
            align.Scoring.parse(bad)


def test_tandem_repeats_are_those_of_a_loop(spark):
    def brute(s, lo, hi, least):
        out, before = [], (-1, -1, -1, -1)
        for i in range(len(s)):
            best = None
            for u in range(lo, hi + 1):
                end = i + u
                while end + u <= len(s) and s[end : end + u] == s[i : i + u] and s[i] != "n":
                    end += u
                if end <= len(s) and s[i] != "n" and end - i >= least and end - i > u and (best is None or end - i > best[0]):
                    best = (end - i, u)
            if best:
                size, u = best
                if not (i == before[0] + 1 and u == before[1] and size == before[2]) and i + size - 1 > before[3]:
                    out.append((i + 1, i + size, size, u, s[i : i + u]))
                before = (i, u, size, i + size - 1)
        return out

    seqs = {1: "acacacacgtgtgtaaaaaaaac", 2: "", 3: "nnnnnnnnn", 4: genome(300, 3) + "acgtacgtacgt" + genome(50, 4)}
    got = stats.tandem_repeats(frame(spark, list(seqs.items())), 1, 4, 6)
    want = {(c, *r) for c, s in seqs.items() for r in brute(s, 1, 4, 6)}
    assert {tuple(r) for r in got.collect()} == want


def scored_frame(spark, rows):
    return spark.createDataFrame(rows, "read_id long, end_no int, contig long, position long, strand string, score int")


def test_choice_and_quality(spark):
    a = scored_frame(spark, [(1, 1, 1, 5, "+", 100), (1, 1, 1, 9, "+", 80), (2, 1, 1, 5, "+", 50), (2, 1, 2, 5, "-", 50), (3, 1, 1, 1, "+", -5)])
    ids = lambda df: sorted((r.read_id, r.position, r.contig) for r in df.collect())
    assert ids(select.chosen(a, 2)) == [(3, 1, 1)]
    assert ids(select.chosen(a, 3)) == [(1, 5, 1), (3, 1, 1)]
    assert ids(select.chosen(a, 4)) == [(1, 5, 1), (2, 5, 1), (2, 5, 2), (3, 1, 1)]
    q = {(r.read_id, r.position, r.contig): r.mapq for r in align.mapping_quality(a, F.lit(50.0), F.lit(2), F.lit(0)).collect()}
    assert q[(2, 5, 1)] == q[(2, 5, 2)] == q[(1, 9, 1)] == 0
    assert q[(1, 5, 1)] == int(0.2 * 250 / 100 * 21 + 0.99999) and q[(3, 1, 1)] == 1
    picked = select.chosen(a.withColumn("mapq", F.lit(7)), 3, random_best=True).collect()
    assert len(picked) == 3 and {r.mapq for r in picked if r.read_id == 2} == {0}


def test_pairs(spark):
    a = scored_frame(spark, [(1, 1, 1, 100, "+", 10), (1, 2, 1, 200, "+", 10), (1, 2, 1, 5000, "+", 10), (2, 1, 1, 5, "+", 9)])
    rows = select.scored_pairs(a, select.InsertSize(100.0, 10.0))
    # Over three deviations off costs 200 * -log10(erfc(3 / sqrt(2))).
    assert {r.position_2: r.pair_score for r in rows.collect()} == {200: 20, 5000: 20 - 514}
    best = select.best_pairs(rows, 50, F.lit(100)).collect()
    assert [(r.position_1, r.position_2) for r in best] == [(100, 200)] and best[0].pair_score == 20
    assert select.insert_size(select.distances(a)) == select.InsertSize()


def test_error_function(spark):
    import math

    xs = [i / 10 for i in range(30)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(select.erfc(F.col("x"))).collect()
    assert max(abs(g[0] - math.erfc(x)) for g, x in zip(got, xs)) < 2e-7


def test_stream_matches_once(spark, tmp_path):
    from seedloom.streaming.matching import match_stream

    ref, mask = genome(400, 8), Mask("11111111")
    index = seeds(frame(spark, [(1, ref)]), mask)
    source = str(tmp_path / "reads")
    for part in range(2):
        reads_frame(spark, [(10 * part + i, 1, ref[30 * i : 30 * i + 25]) for i in range(5)]).write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("read_id long, end_no int, seq string").option("maxFilesPerTrigger", 1).parquet(source)
        match_stream(stream, index, key_frequency(index), mask, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.read_id for r in rows} == {*range(5), *range(10, 15)} and len(rows) == len({(r.read_id, r.position, r.strand) for r in rows})


def test_windows_of_long_reads_cross_chunks(spark):
    rng = random.Random(12)
    text = "".join(rng.choices("acgt", k=10_000))
    places = [(1, 3000, "+"), (2, 4090, "-"), (3, 4096, "+"), (4, 4097, "+"), (5, 1, "-"), (6, 7990, "+"), (7, 9000, "-"), (3, 4096, "+")]
    cals = spark.createDataFrame([(i, 1, 5, p, s, 5500 if i == 1 else 2000) for i, p, s in places], "read_id long, end_no int, contig long, position int, strand string, length int")
    pieces = align.chunks(spark.createDataFrame([(5, text)], "contig long, seq string"))
    got = sorted((r.read_id, r.window, r.window_start, r.window_offset) for r in align.fetched(cals, pieces).collect())
    want = []
    for i, p, strand in places:
        n, lo = 5500 if i == 1 else 2000, max(p - 20, 1)
        w = text[lo - 1 : p + n + 19]
        turned = w[::-1].translate(str.maketrans("acgt", "tgca"))
        want.append((i, turned if strand == "-" else w, lo, len(w) - (p - lo) - n if strand == "-" else p - lo))
    assert got == sorted(want)


def test_sought_seeds_are_those_of_the_keys(spark, monkeypatch):
    rng = random.Random(4)
    ref = spark.createDataFrame([(i, "".join(rng.choices("acgtN", k=400))) for i in range(5)], "contig long, seq string")
    rows = spark.createDataFrame([(1, 1, "acgtacgtacgt"), (2, 1, "ttttttttgaca")], "read_id long, end_no int, seq string")
    mask = Mask("11011")
    keys = read_keys(rows, mask)
    want = sorted(map(tuple, seeds(ref, mask).join(keys.select("key").distinct(), "key", "left_semi").select("contig", "pos", "key").collect()))
    assert want
    for most in (1 << 20, 1):
        monkeypatch.setattr(m, "MOST_SOUGHT", most)
        assert sorted(map(tuple, m.sought_seeds(keys, ref, mask).collect())) == want


def test_color_seeds_and_places(spark):
    """A read cut from either strand, as colours from an adaptor, is found where it was cut."""
    rng = random.Random(6)
    text = "".join(rng.choices("acgt", k=900)) + "N" + "".join(rng.choices("acgt", k=100))
    ref = spark.createDataFrame([(7, text)], "contig long, seq string")
    turned = lambda x: x[::-1].translate(str.maketrans("acgt", "tgca"))
    colors_of = lambda x: "".join(str("acgt".index(a) ^ "acgt".index(b)) for a, b in zip("a" + x, x))
    rows = [(at, 1, "A" + colors_of(cut if at % 2 else turned(cut))) for at in (1, 100, 333, 500, 801) for cut in [text[at - 1 : at + 39]]]
    options = m.MatchOptions(space="color")
    cals, _ = m.match_reference(spark.createDataFrame(rows, "read_id long, end_no int, seq string"), ref, Mask("111110111111"), options)
    got = {(r.read_id, r.position, r.strand) for r in cals.collect()}
    assert {(at, at, "+" if at % 2 else "-") for at in (1, 100, 333, 500, 801)} <= got
    lower = spark.createDataFrame([(1, "ACGTacGTACGTACGT")], "contig long, seq string")
    assert [r.pos for r in seeds(lower, Mask("111"), True, space="color").orderBy("pos").collect()] == [1, 2, *range(8, 15)]


def test_binned_index_is_the_unsplit_one(spark, tmp_path):
    rng = random.Random(5)
    ref = spark.createDataFrame([(i, "".join(rng.choices("acgt", k=500))) for i in range(4)], "contig long, seq string")
    rows = spark.createDataFrame([(1, 1, "".join(rng.choices("acgt", k=60))), (2, 1, "acacacacacacacac")], "read_id long, end_no int, seq string")
    mask = Mask("1110111", depth=2)
    write_index(seeds(ref, mask), mask, str(tmp_path / "i"), 3)
    index, frequency, same = read_index(spark, str(tmp_path / "i"), 3)
    keys = read_keys(rows, mask)
    plain = m.united(m.placed(m.key_hits(keys, key_frequency(seeds(ref, mask))), seeds(ref, mask), mask, m.MatchOptions()))
    binned = m.merged_bins(m.placed_by_bin(keys, index, same, m.MatchOptions()), 8)
    assert sorted(map(repr, binned.select(plain.columns).collect())) == sorted(map(repr, plain.collect())) != []
    from seedloom.operators.seeds import read_indexes

    assert len(read_indexes(spark, str(tmp_path / "i"))) == 1
    with pytest.raises(ValueError):
        read_indexes(spark, str(tmp_path / "i"), [1])


def test_region_is_clamped():
    from seedloom.operators.seeds import clamped

    assert clamped((1, 9), (0, 0), (0, 0), 50) == ((1, 1), (9, 50))
    assert clamped((1, 9), (2, 5), (12, 7), 50) == ((2, 5), (9, 50))
    with pytest.raises(ValueError):
        clamped((1, 9), (5, 1), (4, 1), 50)


def test_lines_come_back(spark):
    from seedloom.sources import sequences

    ends = spark.createDataFrame([(1, "a", 1, "acgt", "IIII", 3), (1, "a", 2, "ttt", "III", -1), (2, "b", 1, "gg", "II", 0)], "read_id long, name string, end_no int, seq string, qual string, max_reached int")
    cals = spark.createDataFrame([(1, 1, 5, 9, "+", "1101"), (1, 1, 5, 2, "-", "1011"), (2, 1, 6, 1, "+", "11")], "read_id long, end_no int, contig long, position int, strand string, mask string")
    back, state = sequences.read_match_lines(sequences.match_lines(cals, ends))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cals.collect()))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, ends.collect()))
    found = spark.createDataFrame([(1, 2, 5, 9, "+", 40, 7, "acg-t", "acgtt"), (1, 2, 5, 3, "-", 30, 0, "acgt", "acgt")], "read_id long, end_no int, contig long, position long, strand string, score int, mapq int, aln_read string, aln_ref string")
    back, state = sequences.read_alignment_lines(sequences.alignment_lines(found, ends))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, found.collect()))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, ends.drop("max_reached").collect()))
    assert sequences.offsets("0,3,10") == [0, 3, 10]
    for bad in ("3,3", "-1", "5,2"):
        with pytest.raises(ValueError):
            sequences.offsets(bad)


def test_numbers_of_many_parts(spark):
    from seedloom.sources import sequences

    rows = spark.range(1000).selectExpr("id * 7919 % 1009 AS v").repartition(9)
    got = sorted((r.n, r.v) for r in sequences.numbered(rows, ["v"], 17, 400).collect())
    assert got == list(enumerate(sorted(i * 7919 % 1009 for i in range(1000)), 1))[16:400]


def test_windows_in_exons(spark):
    index = spark.createDataFrame([(1, p, 0) for p in range(1, 9000, 37)], "contig long, pos int, key long")
    exons = [(1, 5, 4200), (1, 4000, 4100), (1, 8190, 8999), (1, 50, 40), (2, 1, 9000)]
    got = sorted(r.pos for r in in_exons(index, Mask("1101"), spark.createDataFrame(exons, "contig long, start long, end long")).collect())
    assert got == [p for p in range(1, 9000, 37) if any(c == 1 and a <= p and p + 3 <= b for c, a, b in exons)]


def test_untested_helpers(spark):
    from seedloom.operators import stats
    from seedloom.operators.seeds import checked_exons, compatible

    meta = spark.createDataFrame([(1, "nt", 1), (2, "nt", 1)], "index_no int, space string, start_contig long")
    assert compatible(meta) and not compatible(meta.union(spark.createDataFrame([(3, "color", 1)], meta.schema)))
    exons = spark.createDataFrame([(1, 1, 5), (1, 5, 9), (1, 20, 10), (2, 1, 2)], "contig long, start long, end long")
    assert sorted(r.start for r in checked_exons(exons).collect()) == [5, 20]
    assert tuple(stats.against_expected(spark.createDataFrame([(1, 2), (2, 2), (5, 2), (4, 2)], "score int, expected int")).first()) == (1, 1, 2)
    best = align.best_only(spark.createDataFrame([(1, 1, 5), (1, 1, 7), (1, 2, 3)], "read_id long, end_no int, score int"))
    assert sorted(r.score for r in best.collect()) == [3, 7]


def test_pairs_have_the_proper_bit(spark):
    """Two ends cut 100 apart come back as a proper pair, and their records say so."""
    from seedloom.functions import sam
    from seedloom.plans.workflow import paired_alignments, scored_alignments

    rng = random.Random(12)
    text = "".join(rng.choices("acgt", k=800))
    ref = spark.createDataFrame([(1, text)], "contig long, seq string")
    rows = [(1, 1, text[100:140]), (1, 2, text[200:240]), (2, 1, text[300:340]), (2, 2, text[700:740]), (3, 1, text[500:540]), (3, 2, "".join(rng.choices("acgt", k=40)))]
    reads = spark.createDataFrame(rows, "read_id long, end_no int, seq string")
    found = paired_alignments(scored_alignments(reads, ref, Mask("1" * 14)), reads, insert=select.InsertSize(100.0, 20.0))
    got = {(r.read_id, r.end_no): (r.position, r.proper) for r in found.collect()}
    assert got == {(1, 1): (101, True), (1, 2): (201, True), (2, 1): (301, False), (2, 2): (701, False), (3, 1): (501, False)}
    ends = reads.withColumn("name", F.col("read_id").cast("string")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    lines = sam.records(found, ends, spark.createDataFrame([(1, "c")], "contig long, name string")).collect()
    flags = {(r.read_id, r.end_no): int(r.line.split("\t")[1]) for r in lines}
    assert flags == {(1, 1): 67, (1, 2): 131, (2, 1): 65, (2, 2): 129, (3, 1): 73, (3, 2): 133}
