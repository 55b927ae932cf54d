"""Scored alignments of reads at candidate places: reference windows, kernels in numpy, mapping quality.

Windows are fetched by an equi-join with a chunked reference, so no task holds a long contig. Exact
placements are settled by comparing strings; only the rest enter the kernels, a batch of candidates at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import bases_of_colors, normalised_color_read, reverse_complement
from ..storage import stored

LOW = -(1 << 27)
ALIGNMENT = "contig long, position long, strand string, score int, aln_read string, aln_ref string"


@dataclass(frozen=True)
class Scoring:
    """Scores of a gap's first and further bases, of equal and unequal bases, and of equal and unequal colours."""

    gap_open: int = -175
    gap_extend: int = -50
    nt_match: int = 50
    nt_mismatch: int = -150
    color_match: int = 0
    color_mismatch: int = -125

    def __post_init__(self):
        if self.gap_open > 0 or self.gap_extend > 0 or self.nt_match < 0 or self.nt_mismatch > 0 or self.color_match < 0 or self.color_mismatch > 0:
            raise ValueError("gaps and mismatches mustn't add to a score, nor matches take from it")
        if self.gap_open > self.gap_extend:
            raise ValueError("a gap's first base mustn't cost less than a further one")
        if self.gap_extend < self.nt_mismatch:
            raise ValueError("a gap's further base mustn't cost more than a mismatch")

    @classmethod
    def parse(cls, text: str) -> Scoring:
        """Four numbers, or six with colours."""
        numbers = [int(x) for x in text.split()]
        if len(numbers) not in (4, 6):
            raise ValueError("four or six numbers")
        return cls(*numbers)

    def best(self, space: str) -> int:
        """What a read's base adds at most."""
        return self.nt_match + (self.color_match if space == "color" else 0)


#: Chunks of an output batch.
CHUNKS = 1024


def chunks(reference: DataFrame, size: int = 4096) -> DataFrame:
    """reference (contig, seq) -> contig, chunk (from 0), start (from 1), seq of ``size`` bases at most."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for contig, seq in zip(b.column("contig").to_pylist(), b.column("seq").to_pylist()):
                seq = seq or ""
                for first in range(0, len(seq), size * CHUNKS):
                    at = list(range(first, min(first + size * CHUNKS, len(seq)), size))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([contig] * len(at), pa.int64()), pa.array([a // size for a in at], pa.int32()), pa.array([a + 1 for a in at], pa.int64()), pa.array([seq[a : a + size] for a in at], pa.string())],
                        names=["contig", "chunk", "start", "seq"],
                    )

    return reference.select(F.col("contig").cast("long").alias("contig"), "seq").mapInArrow(cut, "contig long, chunk int, start long, seq string")


def fetched(cals: DataFrame, pieces: DataFrame, offset: int = 20, size: int = 4096) -> DataFrame:
    """Candidates with ``window``: the reference from ``offset`` before their place to ``offset`` after their end, clamped to the contig,
    in the read's direction; and ``window_start``, its first place, and ``window_offset``, where the read would begin in it."""
    lo = F.greatest(F.col("position") - offset, F.lit(1))
    placed = cals.withColumn("_lo", lo.cast("long")).withColumn("_n", (F.col("position") + F.col("length") + offset - lo).cast("int"))
    # A window may touch any number of chunks, each of which gives what it holds of it.
    own, end, stop = placed.columns, F.col("_lo") + F.col("_n"), F.col("start") + size
    first, last = (F.floor((c - 1) / size).cast("int") for c in (F.col("_lo"), end - 1))
    touched = placed.withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, last)))).join(pieces, ["contig", "chunk"])
    begin = F.greatest(F.col("_lo"), F.col("start"))
    part = F.substring(F.col("seq"), (begin - F.col("start") + 1).cast("int"), (F.least(end, stop) - begin).cast("int"))
    grouped = touched.groupBy(*own).agg(F.sort_array(F.collect_set(F.struct("chunk", part.alias("part")))).alias("_parts"), F.count(F.lit(1)).alias("_rows"))
    again = F.explode(F.array_repeat(F.lit(0), (F.col("_rows") / F.size("_parts")).cast("int")))  # candidates that repeat
    joined = grouped.withColumn("_again", again).withColumn("_forward", F.array_join(F.transform("_parts", lambda p: p["part"]), ""))
    forward = F.col("_forward")
    window = F.when(F.col("strand") == "-", reverse_complement(forward)).otherwise(forward)
    before = F.col("position") - F.col("_lo")
    after = F.length(forward) - before - F.col("length")
    return joined.withColumn("window", window).withColumn("window_offset", F.when(F.col("strand") == "-", after).otherwise(before).cast("int")).withColumn("window_start", F.col("_lo")).drop("_lo", "_n", "_parts", "_rows", "_again", "_forward")


def is_exact(read: Column, window: Column, window_offset: Column) -> Column:
    return (window_offset >= 0) & (F.lower(F.substring(window, window_offset + 1, F.length(read))) == F.lower(read))


def _bytes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode(), np.uint8)


def _masks(masks: Sequence[str], n: int) -> np.ndarray:
    return np.stack([_bytes(x.ljust(n, "0")[:n]) == ord("1") for x in masks])


def ungapped_batch(reads: Sequence[str], windows: Sequence[str], masks: Sequence[str] | None, offset: int, s: Scoring) -> list[tuple[int, int] | None]:
    """(score, start in the window) of each read's best start, the first of equals; with ``masks`` their 1s have to match. None if there is no start.

    All reads are of one length, and all windows. Starts leave ``offset`` bases on either side.
    """
    r, w = (np.stack([_bytes(x.lower()) for x in xs]) for xs in (reads, windows))
    (b, n), m = r.shape, w.shape[1]
    low = max(offset, 0)
    many = m - n - offset + 1 - low
    if many < 1 or not n:
        return [None] * b
    equal = np.lib.stride_tricks.sliding_window_view(w, n, axis=1)[:, low : low + many] == r[:, None, :]
    scores = s.nt_mismatch * n + (s.nt_match - s.nt_mismatch) * equal.sum(axis=2)
    if masks is not None:
        scores = np.where((equal | ~_masks(masks, n)[:, None, :]).all(axis=2), scores, LOW)
    best = scores.argmax(axis=1)
    return [None if scores[i, k] <= LOW else (int(scores[i, k]), low + int(k)) for i, k in enumerate(best.tolist())]


def ungapped(read: str, window: str, mask: str | None, offset: int, s: Scoring) -> tuple[int, int] | None:
    """``ungapped_batch`` of one read."""
    if len(read) > len(window) or not read:
        return None
    return ungapped_batch([read], [window], None if mask is None else [mask], offset, s)[0]


def colors_of(bases: np.ndarray, before: int = 0) -> np.ndarray:
    """Colours of base codes (0 to 4), the first against ``before``."""
    last = np.concatenate([[before], bases[:-1]])
    return np.where((last > 3) | (bases > 3), 4, last ^ bases)


def codes_of(text: str) -> np.ndarray:
    table = np.full(256, 4, np.int64)
    for i, (a, b) in enumerate(zip(b"ACGT", b"acgt")):
        table[a] = table[b] = i
    return table[_bytes(text)]


def _digits(colors: Sequence[str]) -> np.ndarray:
    return np.stack([np.array([int(x) if x in "0123" else 4 for x in c], np.int64) for c in colors])


#: Colour from base to base.
STEP = np.arange(4)[:, None] ^ np.arange(4)[None, :]


def _paid(color: np.ndarray, s: Scoring) -> np.ndarray:
    """What each step from base to base pays for the colours read (batch): (batch, from, to)."""
    return np.where(color[:, None, None] == STEP, s.color_match, s.color_mismatch)


def ungapped_color_batch(colors: Sequence[str], windows: Sequence[str], masks: Sequence[str] | None, offset: int, s: Scoring) -> list[tuple[int, int, str] | None]:
    """(score, start, bases): the best reading of each read's colours (digits, from base A) at the best start of its nucleotide window.

    A reading pays for bases unlike the reference and for colours unlike those read; a Viterbi pass finds it for all reads and
    starts at once. With ``masks``, the colours at their 1s have to be those of the reference. Of equal starts the first, of equal bases the least.
    All reads are of one length, and all windows.
    """
    c, w = _digits(colors), np.stack([codes_of(x) for x in windows])
    (b, n), m, low = c.shape, w.shape[1], max(offset, 0)
    many = m - n - offset + 1 - low
    if many < 1 or not n:
        return [None] * b
    refs = np.lib.stride_tricks.sliding_window_view(w, n, axis=1)[:, low : low + many]
    score = np.full((b, many, 4), LOW)
    score[:, :, 0] = 0  # the adaptor's A
    back = np.zeros((n, b, many, 4), np.int8)
    for i in range(n):
        every = score[:, :, :, None] + _paid(c[:, i], s)[:, None]
        back[i] = every.argmax(axis=2)
        score = every.max(axis=2) + np.where(refs[:, :, i, None] == np.arange(4), s.nt_match, s.nt_mismatch)
    total = score.max(axis=2)
    if masks is not None:
        bound = _masks(masks, n)
        bound[:, 0] = False
        last = refs[:, :, :-1]
        seen = np.where((last > 3) | (refs[:, :, 1:] > 3), 4, last ^ refs[:, :, 1:])
        total = np.where(((seen == c[:, None, 1:]) | ~bound[:, None, 1:]).all(axis=2), total, LOW)
    out: list[tuple[int, int, str] | None] = []
    for i, k in enumerate(total.argmax(axis=1).tolist()):
        if total[i, k] <= LOW // 2:
            out.append(None)
            continue
        base, read = int(score[i, k].argmax()), []
        for at in range(n - 1, -1, -1):
            read.append("ACGT"[base])
            base = int(back[at, i, k, base])
        out.append((int(total[i, k]), low + k, "".join(reversed(read))))
    return out


def ungapped_color(colors: str, window: str, mask: str | None, offset: int, s: Scoring) -> tuple[int, int, str] | None:
    """``ungapped_color_batch`` of one read."""
    if len(colors) > len(window) or not colors:
        return None
    return ungapped_color_batch([colors], [window], None if mask is None else [mask], offset, s)[0]


def _filled(read: np.ndarray, ref: np.ndarray, s: Scoring, corner: bool) -> tuple[np.ndarray, ...]:
    """Affine-gap matrices (rows of the read, batch, columns of the reference) of reads and references of one shape.

    ``corner``: paths begin at the first cell, else anywhere in the first row. The whole row of deletions is a running
    maximum, since no better path reopens a gap that it is in.
    """
    b, n = read.shape
    m = ref.shape[1]
    best, down, across = (np.full((n + 1, b, m + 1), LOW, np.int32) for _ in range(3))
    steps = s.gap_extend * np.arange(m + 1)
    best[0] = 0
    if corner:
        across[0, :, 1:] = s.gap_open + steps[:-1]
        best[0, :, 1:] = across[0, :, 1:]
    for i in range(1, n + 1):
        diagonal = np.full((b, m + 1), LOW, np.int32)
        equal = read[:, i - 1, None] == ref
        diagonal[:, 1:] = best[i - 1, :, :-1] + np.where(equal, s.nt_match, s.nt_mismatch)
        down[i] = np.maximum(down[i - 1] + s.gap_extend, best[i - 1] + s.gap_open)
        down[i, :, 0] = s.gap_open + s.gap_extend * (i - 1)
        entry = np.maximum(diagonal, down[i])
        run = np.maximum.accumulate(entry - steps, axis=1)
        across[i, :, 1:] = run[:, :-1] + steps[:-1] + s.gap_open
        best[i] = np.maximum(entry, across[i])
    return best, down, across


def _traced(matrices: tuple[np.ndarray, ...], b: int, read: str, ref: str, row: int, col: int, s: Scoring, corner: bool) -> tuple[str, str, int]:
    """(aligned read, aligned reference, first column) of the path that ends at (row, col). A diagonal step wins ties, then a deletion; going on with a gap wins over opening it."""
    best, down, across = matrices
    a, r, state = [], [], "s"
    while row > 0 or (corner and col > 0):
        if state == "s":
            here = best[row, b, col]
            if row > 0 and col > 0:
                d = best[row - 1, b, col - 1] + (s.nt_match if read[row - 1].lower() == ref[col - 1].lower() else s.nt_mismatch)
                if here == d:
                    a.append(read[row - 1])
                    r.append(ref[col - 1])
                    row, col = row - 1, col - 1
                    continue
            state = "h" if col > 0 and here == across[row, b, col] else "v"
        elif state == "h":
            stays = across[row, b, col - 1] + s.gap_extend >= best[row, b, col - 1] + s.gap_open
            a.append("-")
            r.append(ref[col - 1])
            col, state = col - 1, "h" if stays else "s"
        else:
            stays = row > 1 and down[row - 1, b, col] + s.gap_extend >= best[row - 1, b, col] + s.gap_open
            a.append(read[row - 1])
            r.append("-")
            row, state = row - 1, "v" if stays else "s"
    return "".join(reversed(a)), "".join(reversed(r)), col


def gapped(reads: list[str], windows: list[str], s: Scoring) -> list[tuple[int, int, str, str]]:
    """(score, start, aligned read, aligned reference) of each read in its window: the whole read, locally in the reference. All reads are of one length, and all windows."""
    codes = lambda xs: np.stack([_bytes(x.lower()) for x in xs])
    matrices = _filled(codes(reads), codes(windows), s, False)
    last, out = matrices[0][-1], []
    for b, (read, window) in enumerate(zip(reads, windows)):
        col = int(last[b].argmax())
        a, r, start = _traced(matrices, b, read, window, len(read), col, s, False)
        out.append((int(last[b, col]), start, a, r))
    return out


def gapped_constrained(reads: list[str], windows: list[str], first: int, last: int, offset: int, s: Scoring) -> list[tuple[int, int, str, str]]:
    """As ``gapped``, for paths that go along the diagonal at ``offset`` from place ``first`` of the read, the first 1 of its mask, to ``last``, the last.

    All reads are of one length, and all windows, and their masks begin and end alike. Where the diagonal isn't in the window, or there is no 1 (``first`` below 0), nothing binds.
    """
    if first < 0 or offset < 0 or offset + last >= len(windows[0]):
        return gapped(reads, windows, s)
    low = [np.stack([_bytes(x.lower()) for x in xs]) for xs in (reads, windows)]
    column = offset + first
    before = _filled(low[0][:, :first], low[1][:, :column], s, False) if first else None
    middle = np.where(low[0][:, first:last] == low[1][:, column : offset + last], s.nt_match, s.nt_mismatch).sum(axis=1)
    behind = _filled(low[0][:, last:], low[1][:, offset + last :], s, True)
    ends, out = behind[0][-1], []
    for b, (read, window) in enumerate(zip(reads, windows)):
        score, a, r, start = int(middle[b]), "", "", column
        if before is not None:
            score += int(before[0][first, b, column])
            a, r, start = _traced(before, b, read[:first], window[:column], first, column, s, False)
        col = 1 + int(ends[b, 1:].argmax())
        a2, r2, _ = _traced(behind, b, read[last:], window[offset + last :], len(read) - last, col, s, True)
        out.append((score + int(ends[b, col]), start, a + read[first:last] + a2, r + window[column : offset + last] + r2))
    return out


def _filled_color(c: np.ndarray, w: np.ndarray, s: Scoring, corner: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Affine-gap matrices (rows of the read, batch, columns of the reference, bases) of colours and references (codes) of one shape.

    A cell has a score for each base that the read may have reached. A base of the read pays for its colour, and for being unlike the reference or for
    its gap; a deletion leaves the read where it is. ``corner``: scores by base (batch, 4) at the first cell, where paths then begin; else they begin with
    the adaptor's A anywhere in the first row.
    """
    (b, n), m = c.shape, w.shape[1]
    best, down, across = (np.full((n + 1, b, m + 1, 4), LOW, np.int32) for _ in range(3))
    steps = s.gap_extend * np.arange(m + 1)[:, None]
    if corner is None:
        best[0, :, :, 0] = 0
    else:
        best[0, :, 0] = corner
        across[0, :, 1:] = corner[:, None, :] + s.gap_open + steps[:-1]
        best[0, :, 1:] = across[0, :, 1:]
    like = np.where(w[:, :, None] == np.arange(4), s.nt_match, s.nt_mismatch)
    for i in range(1, n + 1):
        paid = _paid(c[:, i - 1], s)[:, None]
        moved = (best[i - 1][:, :, :, None] + paid).max(axis=2)  # over the bases before
        diagonal = np.full((b, m + 1, 4), LOW, np.int64)
        diagonal[:, 1:] = moved[:, :-1] + like
        down[i] = np.maximum((down[i - 1][:, :, :, None] + paid).max(axis=2) + s.gap_extend, moved + s.gap_open)
        entry = np.maximum(diagonal, down[i])
        run = np.maximum.accumulate(entry - steps, axis=1)
        across[i, :, 1:] = run[:, :-1] + steps[:-1] + s.gap_open
        best[i] = np.maximum(entry, across[i])
    return best, down, across


def _traced_color(matrices: tuple[np.ndarray, ...], b: int, c: np.ndarray, w: np.ndarray, window: str, row: int, col: int, base: int, s: Scoring, corner: bool) -> tuple[str, str, int, int]:
    """(aligned bases, aligned reference, first column, base before) of the path that ends at (row, col, base). A diagonal step wins ties, then a deletion, then the lesser base."""
    best, down, across = (x[:, b] for x in matrices)
    a, r, state = [], [], "s"
    while row > 0 or (corner and col > 0):
        paid = np.where(STEP[:, base] == c[row - 1], s.color_match, s.color_mismatch) if row else None
        if state == "s":
            if row > 0 and col > 0:
                before = best[row - 1, col - 1] + paid
                if best[row, col, base] == before.max() + (s.nt_match if w[col - 1] == base else s.nt_mismatch):
                    a.append("ACGT"[base])
                    r.append(window[col - 1])
                    row, col, base = row - 1, col - 1, int(before.argmax())
                    continue
            state = "h" if col > 0 and best[row, col, base] == across[row, col, base] else "v"
        elif state == "h":
            stays = across[row, col - 1, base] + s.gap_extend >= best[row, col - 1, base] + s.gap_open
            a.append("-")
            r.append(window[col - 1])
            col, state = col - 1, "h" if stays else "s"
        else:
            a.append("ACGT"[base])
            r.append("-")
            going, opened = down[row - 1, col] + paid, best[row - 1, col] + paid
            stays = row > 1 and going.max() + s.gap_extend >= opened.max() + s.gap_open
            row, base, state = row - 1, int((going if stays else opened).argmax()), "v" if stays else "s"
    return "".join(reversed(a)), "".join(reversed(r)), col, base


def gapped_color_batch(colors: Sequence[str], windows: Sequence[str], s: Scoring) -> list[tuple[int, int, str, str]]:
    """(score, start, aligned bases, aligned reference) of each read's colours (digits, from base A) in its nucleotide window, with gaps.

    All reads are of one length, and all windows.
    """
    c, w = _digits(colors), np.stack([codes_of(x) for x in windows])
    matrices, n, out = _filled_color(c, w, s, None), c.shape[1], []
    for b, window in enumerate(windows):
        col, base = divmod(int(matrices[0][n, b].argmax()), 4)
        a, r, start, _ = _traced_color(matrices, b, c[b], w[b], window, n, col, base, s, False)
        out.append((int(matrices[0][n, b, col, base]), start, a, r))
    return out


def gapped_color(colors: str, window: str, s: Scoring) -> tuple[int, int, str, str]:
    """``gapped_color_batch`` of one read."""
    return gapped_color_batch([colors], [window], s)[0]


def gapped_color_constrained(colors: Sequence[str], windows: Sequence[str], masks: Sequence[str], first: int, last: int, offset: int, s: Scoring) -> list[tuple[int, int, str, str]]:
    """As ``gapped_color_batch``, for paths that go along the diagonal at ``offset`` from place ``first`` of the read, the first 1 of its mask, to ``last``, the last;
    at its 1s between them a base is reached by the colour read.

    The path has three parts, each with a score for each base that the read may have reached: up to ``first`` it is free, along the diagonal bases are told by a
    Viterbi pass, and from ``last`` on it is free again. All reads are of one length, and all windows, and their masks begin and end alike. Where the diagonal isn't
    in the window, or there is no 1 (``first`` below 0), nothing binds.
    """
    if first < 0 or offset < 0 or offset + last >= len(windows[0]):
        return gapped_color_batch(colors, windows, s)
    c, w = _digits(colors), np.stack([codes_of(x) for x in windows])
    bound, (b, n), column = _masks(masks, c.shape[1]), c.shape, offset + first
    before = _filled_color(c[:, :first], w[:, :column], s, None) if first else None
    score = before[0][first, :, column].astype(np.int64) if before is not None else np.where(np.arange(4) == 0, 0, LOW) * np.ones((b, 1), np.int64)
    back = np.zeros((n, b, 4), np.int8)
    for i in range(first, last):
        paid = _paid(c[:, i], s)
        tied = bound[:, i, None, None] & (c[:, i, None, None] < 4) & (c[:, i, None, None] != STEP)
        every = score[:, :, None] + np.where(tied, LOW, paid)
        back[i] = every.argmax(axis=1)
        score = np.maximum(every.max(axis=1), LOW) + np.where(w[:, offset + i, None] == np.arange(4), s.nt_match, s.nt_mismatch)
    behind = _filled_color(c[:, last:], w[:, offset + last :], s, score.astype(np.int32))
    ends, out = behind[0][-1], []
    for k, window in enumerate(windows):
        col, base = divmod(int(ends[k, 1:].argmax()), 4)
        col += 1
        total = int(ends[k, col, base])
        a2, r2, _, base = _traced_color(behind, k, c[k, last:], w[k, offset + last :], window[offset + last :], n - last, col, base, s, True)
        middle = []
        for i in range(last - 1, first - 1, -1):
            middle.append("ACGT"[base])
            base = int(back[i, k, base])
        a, r, start = "", "", column
        if before is not None:
            a, r, start, _ = _traced_color(before, k, c[k, :first], w[k, :column], window[:column], first, column, base, s, False)
        out.append((total, start, a + "".join(reversed(middle)) + a2, r + window[column : offset + last] + r2))
    return out


#: Cells of the matrices that are filled together, and the most candidates.
CELLS, TOGETHER = 1 << 22, 64


def _kernel(members: list[dict], space: str, gaps: bool, constrained: bool, offset: int, s: Scoring) -> list[tuple | None]:
    """(score, start, aligned read, aligned reference) of candidates of one shape, bound alike; None where one can't be placed."""
    reads, windows, masks = ([x[c] for x in members] for c in ("read", "window", "mask"))
    n, first_one = len(reads[0]), members[0]
    if gaps:
        bind = (first_one["mask"].find("1"), first_one["mask"].rfind("1"), first_one["window_offset"]) if constrained else (-1, -1, 0)
        return gapped_constrained(reads, windows, *bind, s) if space == "nt" else gapped_color_constrained(reads, windows, masks, *bind, s)
    if n > len(windows[0]):
        return [None] * len(members)
    side = 0 if constrained or space == "color" else min(offset, max(0, first_one["window_offset"]))
    if space == "color":
        found = ungapped_color_batch(reads, windows, masks if constrained else None, 0, s)
        return [None if x is None else (*x, w[x[1] : x[1] + n]) for x, w in zip(found, windows)]
    found = ungapped_batch(reads, windows, masks if constrained else None, side, s)
    return [None if x is None else (*x, r, w[x[1] : x[1] + n]) for x, r, w in zip(found, reads, windows)]


def aligned(candidates: DataFrame, s: Scoring = Scoring(), space: str = "nt", gaps: bool = True, constrained: bool = True, offset: int = 20) -> DataFrame:
    """candidates (read_id, end_no, contig, strand, read, mask, window, window_start, window_offset) -> read_id, end_no and an alignment each.

    ``read`` is in read direction (colours without the adaptor in colour space). Candidates that can't be placed give no row.
    """
    keep = ["read_id", "end_no", "contig", "strand"]
    out_schema = "read_id long, end_no int, " + ALIGNMENT

    def place(strand: str, start: int, window: str, window_start: int, used: int) -> int:
        return window_start + (len(window) - used - start if strand == "-" else start)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, alike, out = b.to_pylist(), {}, []
            for i, x in enumerate(rows):
                if x["read"] and x["window"]:
                    bound = (x["mask"].find("1"), x["mask"].rfind("1"), x["window_offset"]) if constrained and gaps else x["window_offset"]
                    alike.setdefault((len(x["read"]), len(x["window"]), bound), []).append(i)
            found: dict[int, tuple] = {}
            for (n, m, _), own in alike.items():
                some = max(1, min(TOGETHER, CELLS // ((n + 1) * (m + 1) * (1 if space == "nt" else 4))))
                for at in range(0, len(own), some):
                    now = own[at : at + some]
                    hits = _kernel([rows[i] for i in now], space, gaps, constrained, offset, s)
                    found.update((i, hit) for i, hit in zip(now, hits) if hit is not None)
            for i in sorted(found):
                x, (score, start, a, r) = rows[i], found[i]
                used = len(r) - r.count("-")
                out.append((x["read_id"], x["end_no"], x["contig"], place(x["strand"], start, x["window"], x["window_start"], used), x["strand"], score, a, r))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["read_id", "end_no", "contig", "position", "strand", "score", "aln_read", "aln_ref"])

    return candidates.select(*keep, "read", "mask", "window", "window_start", "window_offset").mapInArrow(scored, out_schema)


def local_align(
    cals: DataFrame, reads: DataFrame, pieces: DataFrame, s: Scoring = Scoring(), gaps: bool = True, constrained: bool = True, offset: int = 20, max_matches: int = 384, size: int = 4096, space: str = "nt"
) -> DataFrame:
    """Candidates with mask -> alignments, one per (end, contig, position, strand, score). Ends with over ``max_matches`` candidates are passed over.

    Exact placements don't enter the kernels. In colour space reads are an adaptor's base and colours; they are aligned to bases, as those bases that their colours lead to.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("read_id", "end_no"))
    few = cals.withColumn("_n", n).where(F.col("_n") <= max_matches).drop("_n")
    seq = F.col("seq")
    if space == "color":
        seq = F.translate(F.substring(normalised_color_read(seq), F.lit(2), F.length(seq)), ".", "4")
    whole = stored(fetched(few.join(reads.select("read_id", "end_no", seq.alias("read")), ["read_id", "end_no"]), pieces, offset, size), "windows")
    own = bases_of_colors(F.col("read")) if space == "color" else F.col("read")
    exact = is_exact(own, F.col("window"), F.col("window_offset"))
    settled = whole.where(exact).select(
        "read_id", "end_no", "contig", F.col("position").cast("long").alias("position"), "strand", (F.length("read") * s.best(space)).cast("int").alias("score"), own.alias("aln_read"),
        F.substring(F.col("window"), F.col("window_offset") + 1, F.length("read")).alias("aln_ref"),
    )
    return distinct_alignments(settled.unionByName(aligned(whole.where(~exact), s, space, gaps, constrained, offset)))


def distinct_alignments(alignments: DataFrame) -> DataFrame:
    return alignments.dropDuplicates(["read_id", "end_no", "contig", "position", "strand", "score"])


def mapping_quality(alignments: DataFrame, match_score: Column, read_length: Column, miss: Column) -> DataFrame:
    """Alignments with ``mapq``: 0 below an end's best score, and for all if the best is shared; else by the distance to the second best."""
    end = Window.partitionBy("read_id", "end_no")
    best = F.max("score").over(end)
    ranked = alignments.withColumn("_best", best).withColumn("_below", F.when(F.col("score") < F.col("_best"), F.col("score")))
    ranked = ranked.withColumn("_next", F.max("_below").over(end))
    ranked = ranked.withColumn("_n1", F.sum((F.col("score") == F.col("_best")).cast("long")).over(end)).withColumn("_n2", F.sum((F.col("score") == F.col("_next")).cast("long")).over(end))
    b, none = F.col("_best"), F.col("_next").isNull()
    second = F.when(none, F.when(b < 0, b - 1).otherwise(0)).otherwise(F.when(b > 0, F.greatest(F.col("_next"), F.lit(0))).otherwise(F.col("_next")))
    others = F.when(none, 1).otherwise(F.col("_n2"))
    q = F.lit(0.2) * (1 - miss / 255.0) * (250.0 / (match_score * read_length)) * (F.col("_n1") / others) * (b - second + 1)
    whole = F.least(F.greatest((q + 0.99999).cast("int"), F.lit(1)), F.lit(255))
    mapq = F.when((F.col("score") < b) | (F.col("_n1") > 1), 0).otherwise(whole)
    return ranked.withColumn("mapq", mapq.cast("int")).drop("_best", "_below", "_next", "_n1", "_n2")


def best_only(alignments: DataFrame) -> DataFrame:
    best = F.max("score").over(Window.partitionBy("read_id", "end_no"))
    return alignments.withColumn("_best", best).where(F.col("score") == F.col("_best")).drop("_best")
