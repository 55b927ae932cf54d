"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 phrases: each is the longest known phrase and one more
character. The set of phrases is hashed, and the smallest hashes are the fingerprint; the share of
common ones among the smallest of two fingerprints' union estimates how alike the dictionaries are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes that a fingerprint keeps, and the seed of the hash.
KEEP, SEED = 128, 7
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrases(text: str, known: set[str], begun: str = "") -> tuple[list[str], str]:
    """New phrases of ``text`` in order, which join ``known``, and the unfinished one; ``begun`` is what was unfinished before."""
    new, add, p = [], known.add, begun
    for c in text:
        p += c
        if p not in known:
            add(p)
            new.append(p)
            p = ""
    return new, p


def hashes(new: list[str]) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.fromiter([xxh32_intdigest(p, SEED) for p in new], np.uint32, len(new))


def smallest(*parts: np.ndarray) -> np.ndarray:
    every = np.concatenate(parts)
    if len(every) > 4 * KEEP:  # equal hashes are rare: a few more than KEEP hold KEEP different ones
        few = np.partition(every, 2 * KEEP)[: 2 * KEEP]
        if len(np.unique(few)) >= KEEP:
            every = few
    return np.unique(every)[:KEEP]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both that each has; 1 for two empty fingerprints."""
    both = np.union1d(a, b)[:KEEP]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def text_of(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def array_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprint(text: str) -> str:
    return text_of(smallest(hashes(phrases(text, set())[0])))


class Parsed:
    """A text with what its fingerprint and that of its edited text have in common."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.at = len(text) - len(text) // 3
        self.known: set[str] = set()
        new, self.begun = phrases(text[: self.at], self.known)
        self.head = hashes(new)
        new, _ = phrases(text[self.at :], self.known, self.begun)
        self.known.difference_update(new)
        self.own = smallest(self.head, hashes(new))

    def result(self, following: str, following_own: np.ndarray) -> tuple:
        tail = following[: len(self.text) - self.at]
        edited = smallest(self.head, hashes(phrases(tail, self.known, self.begun)[0]))
        digest = hashlib.sha256((self.text[: self.at] + tail).encode()).hexdigest()
        return (self.doc_id, len(self.text), digest, text_of(self.own), text_of(edited), likeness(self.own, edited), likeness(self.own, following_own))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in RESULT.split(", "))])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows in order. A part's last row is lent by the next part: it ends its neighbour's work and has no result here."""
    before, part, rows = None, None, []
    for batch in batches:
        for own, lent, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "lent", "doc_id", "text")]):
            if lent and (before is None or own != part):
                continue  # another row of the lent id
            now = Parsed(doc_id, text)
            if before is not None and own == part:
                rows.append(before.result(now.text, now.own))
            before, part = (None if lent else now), own
            if len(rows) >= 500:
                yield _batch(rows, ARROW)
                rows = []
    yield _batch(rows, ARROW)


def _placed(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` are above an id, by bisection; all for a null id."""
    n = len(bounds)
    every = F.lit(bounds).cast("array<long>")
    span = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halved(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        above = F.try_element_at(every, mid + 1) > doc_id
        go = acc["lo"] < acc["hi"]
        return F.struct(F.when(go & above, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(go & ~above, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.array(*[F.lit(k) for k in range(max(1, n.bit_length()))])
    return F.when(doc_id.isNull(), n).otherwise(F.aggregate(steps, span, halved)["lo"]) if n else F.lit(0)


def compared_in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): fingerprints of each text and of its edited text, and how like they and the next document's are.

    The edited text has its last third (rounded down) replaced by as many code points, or all, of the next
    document, by descending doc_id; the next of the last is the first.

    Ids are cut into parts of about equal size; the first document of a part is lent to the part before
    it, so that texts are shuffled once and every pair meets in a task.

    * A null text is empty; the fingerprint of an empty text is empty, and like another empty one.
    * Null ids come last; rows that repeat an id come in the order of their texts, and rows equal in both are alike.
    * A single document is its own next. An empty table gives no rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in found}, reverse=True)
    # One row a part: its first id.
    found = ids.groupBy(_placed(F.col("doc_id"), bounds).alias("part")).agg(F.max("doc_id").alias("first")).toArrow()
    firsts = dict(zip(found.column("part").to_pylist(), found.column("first").to_pylist()))
    used = sorted(firsts)
    first_of = [firsts.get(k) for k in range(len(bounds) + 1)]
    to = {k: used[i - 1] for i, k in enumerate(used)}
    lent_to = [to.get(k, 0) for k in range(len(bounds) + 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", _placed(F.col("doc_id"), bounds))
    leads = F.col("doc_id").eqNullSafe(F.element_at(F.lit(first_of).cast("array<long>") if any(x is not None for x in first_of) else F.array(*[F.lit(None).cast("long") for _ in first_of]), F.col("own") + 1))
    here = F.struct(F.col("own").alias("part"), F.lit(False).alias("lent"))
    there = F.struct(F.element_at(F.lit(lent_to).cast("array<int>"), F.col("own") + 1).alias("part"), F.lit(True).alias("lent"))
    dealt = rows.select("doc_id", "text", F.inline(F.when(leads, F.array(here, there)).otherwise(F.array(here))))
    order = [F.col("part"), F.col("lent"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    placed = dealt.repartitionByRange("part").sortWithinPartitions(*order)
    return placed.select("part", "lent", "doc_id", "text").mapInArrow(_neighbours, RESULT)
