"""Hierarchical residual packing of documents into sequences.

Each input split is packed by best fit and its nearly full sequences are done. What lies in the others goes up a tree:
``FAN_IN`` splits' residuals are packed together by best fit again, and so on to the root, where all is done.

Pieces of one length are alike, so a node of the tree needs only how many there are of each length: at most ``FAN_IN`` times
``capacity`` counts, however many pieces are open. Its packing is told in runs of sequences that are filled alike, and a piece
finds its place by its node, its length and its number among those. No piece is held back and no group is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .subwords import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, node long, rank long"
STEPS = "node long, length long, first long, pieces long, each long, base long, sequence long, settled boolean, next long"
#: Nodes that a node of the next round takes together. So many nodes' steps are sent to all tasks, too: each has a few for each length.
FAN_IN = 64
#: A sequence is nearly full, and done, if it lacks at most this share of the capacity.
NEARLY = 128
#: Sequences of one node are numbered below this; nodes of all rounds are numbered above it.
NUMBERS = 1 << 40


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still take
    some = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        some |= 1 << (r - n)
    return bins


@dataclass
class Runs:
    """Pieces in order of falling length, in runs: the first piece, its sequence, what lies in that before it, pieces a sequence."""

    first: dict[int, int]  # of each length
    at: np.ndarray
    sequence: np.ndarray
    base: np.ndarray
    each: np.ndarray
    fills: list[tuple[int, int, int]] = field(default_factory=list)  # of sequences: the first, how many, what they hold

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces by length and number among those of that length."""
        kinds, which = np.unique(lengths, return_inverse=True)
        piece = np.array([self.first[int(n)] for n in kinds], np.int64)[which] + ranks
        run = np.searchsorted(self.at, piece, side="right") - 1
        k = piece - self.at[run]
        return self.sequence[run] + k // self.each[run], self.base[run] + k % self.each[run] * lengths


def best_fit_runs(counts: dict[int, int], capacity: int) -> Runs:
    """What ``best_fit`` does, for ``counts`` of pieces by length."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs of sequences (first, how many) by what they still take
    some = 0  # bit r is set if a sequence has room r
    first, runs, done, new = {}, [], 0, 0
    for n in sorted(counts, reverse=True):
        first[n], left = done, counts[n]
        while left:
            fits = some >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                begin, many = room[r].pop()
                if not room[r]:
                    some ^= 1 << r
            else:
                r, begin, many = capacity, new, -(-left // (capacity // n))
                new += many
            # A sequence takes all it can before the next, since it is then the fullest that still takes one.
            each = r // n
            whole = min(many, left // each)
            for k, held in ((whole, each), (min(1, many - whole), left - whole * each)):
                if k and held:
                    runs.append((done, begin, capacity - r, held))
                    room[r - held * n].append((begin, k))
                    some |= 1 << (r - held * n)
                    done, left, begin, many = done + k * held, left - k * held, begin + k, many - k
            if many:
                room[r].append((begin, many))
                some |= 1 << r
    fills = sorted((begin, many, capacity - r) for r, some_of in enumerate(room) for begin, many in some_of)
    return Runs(first, *(np.array(c, np.int64) for c in (zip(*runs) if runs else [[]] * 4)), fills)


def node_steps(counts: dict[int, int], capacity: int, least: int) -> list[tuple]:
    """Where a node's pieces go, in runs of pieces of one length: length, number of the first, how many pieces, pieces a sequence,
    what lies before them, their first sequence, whether that holds ``least`` or more, and their number among what goes on."""
    runs = best_fit_runs(counts, capacity)
    borders: list[tuple[int, int, bool]] = []  # neighbouring sequences that are all done, or all not
    for begin, many, fill in runs.fills:
        if borders and borders[-1][2] == (fill >= least) and borders[-1][1] == begin:
            borders[-1] = (borders[-1][0], begin + many, borders[-1][2])
        else:
            borders.append((begin, begin + many, fill >= least))
    begins = np.array([b[0] for b in borders], np.int64)
    lengths = sorted(counts, reverse=True)
    starts = np.array([runs.first[n] for n in lengths], np.int64)
    rows, onward = [], dict.fromkeys(counts, 0)
    for k in range(len(runs.at)):
        at, begin, base, each = (int(c[k]) for c in (runs.at, runs.sequence, runs.base, runs.each))
        n = lengths[int(np.searchsorted(starts, at, side="right")) - 1]
        end = int(runs.at[k + 1]) if k + 1 < len(runs.at) else sum(counts.values())
        last, b = begin + -(-(end - at) // each), int(np.searchsorted(begins, begin, side="right")) - 1
        while begin < last:
            until, settled = min(last, borders[b][1]), borders[b][2]
            pieces = min(end - at, (until - begin) * each)
            rows.append((n, at - runs.first[n], pieces, each, base, begin, settled, onward[n]))
            onward[n] += 0 if settled else pieces
            at, begin, b = at + pieces, until, b + 1
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """docs (doc_id, text) -> pieces, numbered by length within each input split (node, rank)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_ids(tokenizer), TaskContext.get().partitionId()
        last, seen = end.to_bytes(4, "little"), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                ids = coder.of_text(text or b"") + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows)) if rows else [[] for _ in ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
ARROW, STEP_ARROW = (pa.schema([(n, TYPES[t]) for n, t in (x.split() for x in names.split(", "))]) for names in (PIECES, STEPS))


def steps(counts: DataFrame, capacity: int, least: int) -> DataFrame:
    """counts (node, length, n) -> where each node's pieces go; see ``node_steps``."""

    def told(key: tuple, rows: pa.Table) -> pa.Table:
        held = dict(zip(rows.column("length").to_pylist(), rows.column("n").to_pylist()))
        found = [(key[0].as_py(), *row) for row in node_steps(held, capacity, least)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), STEP_ARROW)], schema=STEP_ARROW)

    return counts.groupBy("node").applyInArrow(told, STEPS)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """docs (doc_id, text) -> a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    * A document is its ids and ``end``; a null or empty text is ``end`` alone. Only documents longer than
      ``capacity`` are cut, into pieces of that length and a last one that may be shorter.
    * Repeated rows are packed as often as they occur. Ids may be null or equal; an empty table gives no rows.
    * An underfull sequence is opened again in the next round: its pieces, not it, are the items, so that what was
      put together for want of better is parted where the other splits have better.
    """
    now = stored(pieces(docs, tokenizer, capacity, end), "pack-pieces")
    counts = stored(now.groupBy("node", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    nodes = (counts.agg(F.max("node")).first()[0] or 0) + 1
    done, level, before = None, 0, 0
    while True:
        root = nodes == 1
        told = stored(steps(counts, capacity, 0 if root else capacity - capacity // NEARLY), f"pack-steps-{level}")
        on = [now[c] == told[c] for c in ("node", "length")]
        on += [now["rank"] >= told["first"], now["rank"] < told["first"] + told["pieces"]]
        k = now["rank"] - told["first"]
        placed = now.join(F.broadcast(told) if nodes <= FAN_IN else told, on).select(
            *[now[c] for c in ARROW.names[:-1]],
            (told["next"] + k).alias("rank"),
            ((F.lit(before) + told["node"]) * NUMBERS + told["sequence"] + F.expr("(rank - first) div each")).alias("sequence_id"),
            (told["base"] + k % told["each"] * told["length"]).alias("offset"),
            "settled",
        )
        if not root:
            placed = stored(placed, f"pack-placed-{level}")
        some = placed.where("settled").select(*ARROW.names[:-2], "sequence_id", "offset")
        done = some if done is None else done.unionByName(some)
        if root:
            return done
        # The pieces that go on are numbered anew, by node, among those of their length in the next round's node.
        parent = F.expr(f"node div {FAN_IN}")
        left = told.where(~F.col("settled")).groupBy("node", "length").agg(F.sum("pieces").alias("n"))
        left = left.withColumn("shift", F.sum("n").over(Window.partitionBy(parent, "length").orderBy("node")) - F.col("n"))
        left = stored(left, f"pack-left-{level}")
        counts = left.groupBy(parent.alias("node"), "length").agg(F.sum("n").alias("n"))
        open_ = placed.where(~F.col("settled")).join(left.drop("n"), ["node", "length"])
        open_ = open_.withColumn("rank", F.col("rank") + F.col("shift")).withColumn("node", parent)
        now = stored(open_.select(*ARROW.names), f"pack-open-{level}")
        level, before, nodes = level + 1, before + nodes, -(-nodes // FAN_IN)
