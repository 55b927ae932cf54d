"""SimHash near-duplicates, compared bit-sliced.

A fingerprint holds the majority bits of the hashes of a document's word shingles. Distinct
fingerprints are dealt into cells by pigeonhole: within ``radius`` differing bits, two
fingerprints agree on whole blocks of bits, so every link lies in some cell. Inside a
cell the fingerprints are stored as bit planes, 64 of them to a machine word; the distance of a
query to all of them grows plane by plane in carry-save counters of three bit slices and
a sticky overflow, and words in which all distances exceed the radius are abandoned. Cells
that hold many fingerprints are cut into chunks whose pairs are separate tasks' work.
A task returns a spanning forest of the links it found, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, apart, as_scan, located, stored, without
from .components import components

BITS = 64
#: Fingerprints that a cell holds on average, and that a chunk of a fuller cell holds.
CELL, CHUNK = 512, 1024
#: Queries compared at once, and planes read before words are first abandoned.
TILE, FIRST_PLANES = 512, 24
#: The greatest distance that counters of three bit slices and their overflow tell from a greater one.
MOST_RADIUS = 7
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, as rows of 8 big-endian bytes; the whole sequence if there are fewer."""
    import xxhash

    found = text.translate(LOWER).split()  # bytes split at space and tab to carriage return alone
    if not found:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    n = min(words, len(found)) - 1
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[n:])]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(text, words)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """docs with a ``text`` column: the other columns and ``fp`` (long). A null text is the empty text."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("fp", "long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(fps)], names=[*rest, "fp"])

    return docs.mapInArrow(hashed, schema)


def _planes(bits: np.ndarray) -> np.ndarray:
    """bits (m, 64) of 0/1 -> bit planes (64, words of 64 fingerprints)."""
    m = len(bits)
    padded = np.zeros((BITS, -(-m // 64) * 64), np.uint8)
    padded[:, :m] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def near_pairs(fps: np.ndarray, radius: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i != j, of fingerprints (uint64) that differ in at most ``radius`` (up to 7) bits; both directions."""
    if radius > MOST_RADIUS:
        raise ValueError(f"the counters tell distances up to {MOST_RADIUS}")
    m = len(fps)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(m, 8), axis=1)
    planes, order = _planes(bits), np.arange(BITS) if order is None else order
    masks = np.where(bits.astype(bool), ALL, np.uint64(0))
    left, right = [], []
    beyond = [k for k in range(8) if k > radius]

    def exceeded(c: list[np.ndarray]) -> np.ndarray:
        """Lanes whose counter value is over the radius."""
        over = c[3]
        for k in beyond:
            over = over | ((c[0] if k & 1 else ~c[0]) & (c[1] if k & 2 else ~c[1]) & (c[2] if k & 4 else ~c[2]))
        return over

    def added(c: list[np.ndarray], x: np.ndarray) -> None:
        carry = c[0] & x
        c[0] ^= x
        x = c[1] & carry
        c[1] ^= carry
        carry = c[2] & x
        c[2] ^= x
        c[3] |= carry

    lanes_of_last = ALL if m % 64 == 0 else np.uint64((1 << (m % 64)) - 1)
    for at in range(0, m, TILE):
        q = masks[at : at + TILE]
        c = [np.zeros((len(q), planes.shape[1]), np.uint64) for _ in range(4)]
        c[3][:, -1] = ~lanes_of_last
        for p in order[:FIRST_PLANES]:
            added(c, planes[p][None, :] ^ q[:, p, None])
        qi, wi = np.nonzero(exceeded(c) != ALL)
        c = [x[qi, wi] for x in c]
        for k, p in enumerate(order[FIRST_PLANES:]):
            added(c, planes[p][wi] ^ q[qi, p])
            if k % 8 == 7:
                alive = np.nonzero(exceeded(c) != ALL)[0]
                qi, wi, c = qi[alive], wi[alive], [x[alive] for x in c]
        hit = ~exceeded(c)
        cell, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = qi[cell] + at, wi[cell] * 64 + lane
        apart = i != j
        left.append(i[apart])
        right.append(j[apart])
    none = np.empty(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def forest(m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index that each of m nodes reaches over symmetric pairs."""
    label = np.arange(m)  # of each node the root of its tree
    while len(left):
        a, b = label[left], label[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, a, b)  # whole trees are hung on the least root beside them, not single nodes
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def scheme(n: int, radius: int) -> tuple[list[tuple[tuple[int, int], ...]], int]:
    """Tables for n fingerprints: the blocks (offset, width) whose bits are a table's key, and the bits of a key that name its cell.

    The number of blocks grows with n until cells hold about ``CELL`` fingerprints at
    uniform bits; ``radius`` differing bits leave all but ``radius`` blocks alike.
    """
    want = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    if want == 0:
        return [()], 0
    for k in range(radius + 1, 2 * radius + 3):
        edges = [round(i * BITS / k) for i in range(k + 1)]
        blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
        tables = list(combinations(blocks, k - radius))
        width = min(sum(w for _, w in t) for t in tables)
        if width + 2 >= want or k == 2 * radius + 2:
            return tables, min(width, want)
    raise AssertionError


def _cell(fp: Column, blocks: tuple[tuple[int, int], ...], bits: int) -> Column:
    key, width = F.lit(0).cast("long"), 0
    for offset, w in blocks:
        part = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << w) - 1))
        key, width = F.shiftleft(key, w).bitwiseOR(part), width + w
    return F.shiftrightunsigned(key, width - bits) if width > bits else key


def links(distinct: DataFrame, radius: int = 4, cell: int | None = None) -> DataFrame:
    """distinct (fp long) -> u, v: edges between fingerprints within ``radius`` bits, a spanning forest of each task's finds."""
    if radius > MOST_RADIUS:
        raise ValueError(f"the counters tell distances up to {MOST_RADIUS}")
    n = distinct.count()
    tables, bits = scheme(n, radius)
    named = [F.struct(F.lit(t).alias("table"), _cell(F.col("fp"), blocks, bits).alias("cell")) for t, blocks in enumerate(tables)]
    dealt = distinct.select("fp", F.inline(F.array(*named)))
    full = stored(dealt.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CHUNK), "simhash-full")
    chunks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / CHUNK).cast("int")
    chunked = (
        dealt.join(full, ["table", "cell"], "left")
        .withColumn("g", F.when(F.col("n").isNull(), 1).otherwise(chunks))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("fp", "table", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    )
    late = [np.array([BITS - 1 - i for o, w in blocks for i in range(o, o + w)], np.int64) for blocks in tables]

    def compared(key: tuple, rows: pa.Table) -> pa.Table:
        fps = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        shared = late[key[0].as_py()]
        order = np.concatenate([np.setdiff1d(np.arange(BITS), shared), shared])
        label = forest(len(fps), *near_pairs(fps, radius, order))
        child = np.nonzero(label != np.arange(len(fps)))[0]
        return pa.table({"u": fps[child].view(np.int64), "v": fps[label[child]].view(np.int64)})

    return chunked.groupBy("table", "cell", "a", "b").applyInArrow(compared, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> the other columns, fp, root (a fingerprint that names the component), component_id.

    * component_id is the smallest doc_id of the documents that links reach; null ids are passed over, and if there
      is no other, it is null.
    * A text that is null, empty or without words has fingerprint 0, and is linked like any other.
    * Repeated rows share their fingerprint. An empty table gives no rows.
    * Columns of ``docs`` that are called as one of the operator's own (fp, root, component_id) give way to it.
    """
    docs = apart(docs, "fp", "root", "component_id")
    marked = stored(fingerprints(docs, words), "simhash-fingerprints")
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = components(links(least.select("fp"), radius))
    classes = least.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = stored(classes, "simhash-classes")
    smallest = stored(classes.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
    named = stored(classes.join(smallest, "root").select("fp", "root", "component_id"), "simhash-named")
    return marked.join(named, "fp", "left")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def kept_documents(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, then of the first place."""
    docs = as_scan(docs, "simhash-input")
    found = stored(near_duplicates(located(docs, "simhash-input", ["doc_id", "text"]), radius, words), "simhash-found")
    candidates = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = candidates.groupBy("root").agg(F.min(F.struct("_file", "_row")).alias("first")).select("first._file", "first._row")
    gone = stored(found.select("_file", "_row").join(stay, ["_file", "_row"], "left_anti"), "simhash-gone")
    return without(docs, gone)
