"""Stored indexes in segments: a task sorts its own seeds, some millions at a time, and writes them as blocks, so that no seed is shuffled to build an index.

A segment has a block of its seeds for each cell of keys: the distinct keys and how often each occurs there, and beside them, as a column of its own, their places. Keys are
a first one in eight bytes and the steps from each to the next. Cells are even shares of a bin's keys, and their numbers begin with the bin's. Whoever seeks keys brings those of a cell to the cell's blocks, and opens the places of what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _turned, numbers, packed_each, planes
from .seeds import OUTSIDE, Mask, bin_of

#: Seeds of a segment, bits that name a cell, and seeds of a block at most (but for a key's own), so that a few thousand blocks fit a task.
SEGMENT, CELLS, PIECE = 1 << 22, 11, 1 << 17
BLOCKS = "key_cell INT, alone BIGINT, keys BINARY, places BINARY"


def _spread(keys: np.ndarray, mask: Mask, back: bool = False) -> np.ndarray:
    """Keys whose bits behind those of the bin are turned (see ``blocks._turned``), so that cells are even; ``back``: what gave them."""
    rest = mask.size - mask.depth
    low = keys & ((1 << 2 * rest) - 1)
    return keys - low + _turned(low, rest, back)


def _shift(mask: Mask) -> int:
    """Bits of a spread key behind those of its cell, which has its bin's at least."""
    return min(max(2 * mask.size - CELLS, 0), 2 * (mask.size - mask.depth))


def _key_blocks(bounds: list[int], keys: np.ndarray, *more: np.ndarray) -> list[bytes]:
    """Rising keys and what goes with them, from one of ``bounds`` to the next."""
    steps = np.diff(keys, prepend=0)
    steps[bounds[:-1]] = 0
    return [first.tobytes() + block for first, block in zip(keys[bounds[:-1]], packed_each(bounds, steps, *more))]


def _keys_of(block: pa.Buffer, columns: int = 1) -> list[np.ndarray]:
    """The keys of a block, and the ``planes`` of what goes with them."""
    steps, *more = planes(memoryview(block)[8:], columns)
    keys = np.cumsum(numbers(steps))
    keys += np.frombuffer(block, np.int64, 1)[0]
    return [keys, *more]


def segments(batches: Iterator[pa.RecordBatch], mask: Mask, common: int) -> Iterator[pa.RecordBatch]:
    """Batches of seeds (contig, pos, key) -> the blocks of their segments, as BLOCKS and ``bin``. A key that occurs over ``common`` times in a segment has blocks that
    hold it alone, with bin OUTSIDE, whose cells are numbered in turn."""
    rest, shift, bits = 2 * (mask.size - mask.depth), _shift(mask), (SEGMENT - 1).bit_length()
    held = [np.empty(SEGMENT, kind) for kind in (np.int64, np.int32, np.int64)]

    def batch(cell: np.ndarray, alone: list, keys: list[bytes], places: list[bytes], bin_: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(cell.astype(np.int32)), pa.array(alone, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.binary()), pa.array(bin_.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["key_cell", "alone", "keys", "places", "bin"])

    def flushed(n: int) -> Iterator[pa.RecordBatch]:
        contig, pos, key = (c[:n] for c in held)
        key = _spread(key, mask)
        if 2 * mask.size + bits <= 63:  # a key and its place in the segment fit one number, which sorts faster
            key <<= bits
            key |= np.arange(n)
            key.sort()
            order = key & ((1 << bits) - 1)
            key >>= bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
        times, key = np.diff(starts, append=n), key[starts]
        many = times > common
        for number, (k, at, t) in enumerate(zip(key[many], starts[many], times[many])):
            ends = [*range(at, at + t, PIECE), at + t]
            parts = [order[a:b] for a, b in zip(ends, ends[1:])]
            own = [_key_blocks([0, 1], np.array([k]), np.array([len(p)]))[0] for p in parts]
            places = [packed_each([0, len(p)], contig[p], pos[p])[0] for p in parts]
            yield batch(number + np.arange(len(parts)), _spread(np.full(len(parts), k), mask, True).tolist(), own, places, np.full(len(parts), OUTSIDE))
        if many.any():
            order, key, times = order[np.repeat(~many, times)], key[~many], times[~many]
        if not len(key):
            return
        contig, pos, upto, cell = contig[order], pos[order], np.concatenate([[0], np.cumsum(times)]), key >> shift
        new = np.concatenate([[True], cell[1:] != cell[:-1]])
        piece = (upto[:-1] - upto[:-1][new][np.cumsum(new) - 1]) // PIECE
        at = np.nonzero(new | np.concatenate([[True], piece[1:] != piece[:-1]]))[0]
        bounds = np.append(at, len(key))
        for some in range(0, len(at), 256):
            a = bounds[some : some + 257]
            k, t, b = key[a[0] : a[-1]], times[a[0] : a[-1]], upto[a]
            places = packed_each((b - b[0]).tolist(), contig[b[0] : b[-1]], pos[b[0] : b[-1]])
            yield batch(cell[a[:-1]], [None] * (len(a) - 1), _key_blocks((a - a[0]).tolist(), k, t), places, key[a[:-1]] >> rest)

    full = 0
    for b in batches:
        columns, at = [b.column(c).to_numpy(zero_copy_only=False) for c in ("contig", "pos", "key")], 0
        while at < b.num_rows:
            n = min(SEGMENT - full, b.num_rows - at)
            for whole, c in zip(held, columns):
                whole[full : full + n] = c[at : at + n]
            full, at = full + n, at + n
            if full == SEGMENT:
                yield from flushed(full)
                full = 0
    if full:
        yield from flushed(full)


def _seeds_of(keys: np.ndarray, bin_: np.ndarray, contig: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(contig), pa.array(pos.astype(np.int32)), pa.array(keys), pa.array(bin_.astype(np.int32))], names=["contig", "pos", "key", "bin"])


@dataclass(frozen=True)
class Segments:
    """Rows of a stored index as its blocks tell them: seeds (contig, pos, key, bin) if ``placed``, else how often each key occurs (key, n, bin). What isn't asked for by
    ``of_keys`` is asked of ``rows``, which opens every block."""

    blocks: DataFrame
    mask: Mask
    placed: bool

    @property
    def schema_text(self) -> str:
        return "contig long, pos int, key long, bin int" if self.placed else "key long, n long"

    @property
    def rows(self) -> DataFrame:
        return self._whole(self.blocks.select(*self._columns).mapInArrow(self._opener(), self.schema_text))

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.rows, name)

    def __getitem__(self, name):
        return self.rows[name]

    @property
    def _columns(self) -> list[str]:
        return ["bin", "keys", "places"] if self.placed else ["keys"]

    def _whole(self, rows: DataFrame) -> DataFrame:
        """Of counts by segment those of all segments."""
        return rows if self.placed else rows.groupBy("key").agg(F.sum("n").alias("n")).withColumn("bin", bin_of(F.col("key"), self.mask))

    def _opener(self):
        """Batches of blocks -> rows; of blocks with ``wanted`` (a cell's keys) those of the wanted keys alone."""
        mask, placed = self.mask, self.placed

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, wanted = None, None  # blocks of a cell follow each other
            for b in batches:
                sought, told, rows = "wanted" in b.schema.names, [], 0
                for number, block in enumerate(b.column("keys")):
                    (key, n), at = _keys_of(block.as_buffer(), 2), None
                    if sought:
                        now = b.column("wanted")[number].as_buffer()
                        if last is None or not now.equals(last):
                            last, wanted = now, _keys_of(now)[0]
                        at = np.searchsorted(key, wanted)
                        at = at[key[np.minimum(at, len(key) - 1)] == wanted]
                        if not len(at):
                            continue
                        key = key[at]
                    if placed:
                        bin_, own, picked = b.column("bin")[number].as_py(), numbers(n), slice(None)
                        if sought:
                            ends, own = np.cumsum(own)[at], own[at]
                            picked = np.repeat(ends - np.cumsum(own), own) + np.arange(own.sum())
                        contig, pos = (numbers(c, picked) for c in planes(b.column("places")[number].as_buffer(), 2))
                        told.append((np.repeat(key, own), np.full(len(contig), bin_), contig, pos))
                    else:
                        told.append((key, numbers(n, slice(None) if at is None else at)))
                    rows += len(told[-1][0])
                    if rows >= 1 << 18:
                        yield made(told)
                        told, rows = [], 0
                if told:
                    yield made(told)

        def made(told: list[tuple]) -> pa.RecordBatch:
            key, *own = (np.concatenate(x) for x in zip(*told))
            key = _spread(key, mask, True)
            return _seeds_of(key, *own) if placed else pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[0])], names=["key", "n"])

        return opened

    def of_keys(self, sought: DataFrame, cells: DataFrame, bins: list[int]) -> DataFrame:
        """The rows of the distinct keys ``sought``, which ``cells`` (see ``cells_of``) has by cell: cells meet in a join, where blocks lie in buckets by cell."""
        near = self.blocks.where(F.col("bin").isin(bins)).join(cells, "key_cell").select(*self._columns, "wanted")
        apart = self.blocks.where(F.col("bin") == OUTSIDE).join(sought, F.col("alone") == sought["key"], "left_semi").select(*self._columns)
        return self._whole(near.mapInArrow(self._opener(), self.schema_text).unionByName(apart.mapInArrow(self._opener(), self.schema_text)))


def cells_of(sought: DataFrame, mask: Mask) -> DataFrame:
    """Distinct keys -> key_cell, wanted: a cell's spread keys as a block."""
    shift = _shift(mask)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _spread(b.column("key").to_numpy(zero_copy_only=False), mask)
            yield pa.RecordBatch.from_arrays([pa.array((key >> shift).astype(np.int32)), pa.array(key)], names=["key_cell", "spread"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = [_key_blocks([0, len(x)], np.sort(x.values.to_numpy()))[0] for x in b.column("keys")]
            yield pa.RecordBatch.from_arrays([b.column("key_cell"), pa.array(wanted, pa.binary())], names=["key_cell", "wanted"])

    rows = sought.select("key").mapInArrow(spread, "key_cell int, spread long").groupBy("key_cell").agg(F.collect_list("spread").alias("keys"))
    return rows.mapInArrow(put, "key_cell int, wanted binary")
