"""Importance resampling towards a target distribution.

Hashed n-gram counts of the source and of the target give each bucket a gain, an array that every task holds; a document's weight is the floored mean
of its features' gains, and Gumbel noise from its id makes the highest scores a draw without replacement. Ranks come from an exact histogram of the integer
scores: suffix sums tell how many documents are above each score and where the draw ends, so only documents from
the last score on are put in order, each among those of its own score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A word is a run of digits, letters of ASCII, and anything beyond it; all else becomes a space, A to Z lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Features that a task remembers with what belongs to them; beyond, its memory begins anew.
MOST_KNOWN = 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by one space."""
    found = list(words)
    for n in range(2, longest + 1):
        found += map(b" ".join, zip(*[islice(words, k, None) for k in range(n)]))
    return found


def bucket_of(feature: bytes, buckets: int) -> int:
    return zlib.crc32(feature) % buckets


def bucket_counts(texts: DataFrame, buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """Features of all texts by bucket. A task sends one row for each bucket it has seen, so that what the driver gathers is bounded by ``buckets``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(buckets, np.int64), Counter()

        def settle() -> None:
            np.add.at(held, np.fromiter((bucket_of(f, buckets) for f in seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for b in batches:
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                seen.update(features_of(words_of(text or b""), longest))
                if len(seen) > MOST_KNOWN:
                    settle()
        settle()
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (float(source.sum()) + n) / ((s + 1) * (float(target.sum()) + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, weight: the mean of the features' gains, floored; 0 without features."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, buckets = gain.tolist(), len(gain)
        known: dict[bytes, int] = {}
        for b in batches:
            n_words, n_features, weights = [], [], []
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                words = words_of(text or b"")
                features = features_of(words, longest)
                new = set(features).difference(known)
                if len(known) + len(new) > MOST_KNOWN:
                    known, new = {}, set(features)
                for f in new:
                    known[f] = own[bucket_of(f, buckets)]
                n_words.append(len(words))
                n_features.append(len(features))
                weights.append(sum(map(known.__getitem__, features)) // len(features) if features else 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(summed, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), where h is the first 32 bits of the SHA-256 of ``seed:doc_id``; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` (doc_id, n_features, weight, score, ...) with ``rank``: 1, 2, 3... for the highest scores among the eligible, ``percent`` of them rounded down, ties to the smaller doc_id.

    The histogram has a row a score: scores are whole, and lie within what gains and noise can be. Documents from the last drawn score on are dealt by
    ranges of (score, doc_id, ...), so that one score's many fall to several tasks: each part's share of a score is numbered by itself, after what the
    histogram has above that score and what the parts before hold of it.
    """
    counts = stored(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    draw = percent * total // 100
    above = counts.withColumn("above", F.sum("n").over(Window.orderBy(F.col("score").desc())) - F.col("n"))
    cutoff = above.where(F.col("above") < draw).agg(F.min("score")).first()[0] if draw else None
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select("*", none)
    surviving = F.coalesce(eligible & (F.col("score") >= cutoff), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", F.col("_at")]
    # Rows alike in all else are told apart by a number, lest they all be one part's.
    few = scored.where(surviving).withColumn("_at", F.monotonically_increasing_id())
    parts = stored(stored(few, "score-surviving").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "score-parts")
    cells = parts.groupBy("score", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("score").orderBy("_part")) - F.col("_n")
    starts = cells.withColumn("_before", earlier).join(above.select("score", "above"), "score").select(F.col("score").alias("_score"), F.col("_part").alias("_own"), (F.col("above") + F.col("_before")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("score", "_part").orderBy(*order[1:]))
    numbered = parts.withColumn("_within", within).join(starts, (F.col("score") == F.col("_score")) & (F.col("_part") == F.col("_own")))
    rank = (F.col("_start") + F.col("_within")).cast("long")
    drawn = numbered.select(*scored.columns, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(scored.where(~surviving).select("*", none))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_words, n_features, weight, score, rank of every document; undrawn ones have no rank.

    * A null text has no words. Texts of fewer than ``least_words`` words have a weight and a score but are never drawn, nor counted for the draw.
    * Rows that repeat an id have one noise; where their scores are equal, too, they are ordered by features and weight, and equal ones alike.
    * An empty table gives no rows; an empty target has no counts. Other columns aren't read.
    * Texts are read twice, for the counts and for the weights; nothing but numbers is shuffled.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(stored(rows, "scored"), F.col("n_words") >= least_words, percent)
