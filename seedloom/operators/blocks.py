"""Whole numbers in compressed blocks, and keys counted by them.

Seeds are many, and most of a shuffle's bytes are a row's own. A task therefore sorts its seeds, some millions at a time, and hands on a block of them for each cell
of keys: what Spark shuffles is a row a block. Cells are even shares of all keys, by a product that turns keys round one to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seeds import LIKELY, Likely, Mask, Texts, _cutter, _scanned, _table_of

#: Seeds that a task sorts at once, and bits that name a cell.
HELD, CELL_BITS = 1 << 23, 12
ODD = 0x9E3779B97F4A7C15 | 1


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length as bytes, a column's lowest ones first, and only as many of each number as its column needs."""
    widths, planes = [], []
    for c in columns:
        c = np.ascontiguousarray(c, np.int64)
        low, high = (int(c.min()), int(c.max())) if len(c) else (0, 0)
        widths.append(8 if low < 0 else (high.bit_length() + 7) // 8)
        planes += [np.ascontiguousarray(c.view(np.uint8)[k::8]) for k in range(widths[-1])]
    return len(columns[0]).to_bytes(4, "little") + bytes(widths) + pa.compress(np.concatenate([*planes, np.empty(0, np.uint8)]), "zstd", asbytes=True)


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    n, widths, out = int.from_bytes(block[:4], "little"), block[4 : 4 + columns], []
    planes = np.frombuffer(pa.decompress(block[4 + columns :], n * sum(widths), "zstd"), np.uint8).reshape(sum(widths), n)
    for k, width in enumerate(widths):
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = planes[sum(widths[:k]) : sum(widths[: k + 1])].T
        out.append(c.view(np.int64).reshape(-1))
    return out


def packed_each(bounds: list[int], *columns: np.ndarray) -> list[bytes]:
    """``packed`` of each stretch of the columns, from one of ``bounds`` to the next; of each number as many bytes as the whole column needs."""
    columns = tuple(np.ascontiguousarray(c, np.int64) for c in columns)
    widths = [8 if c.min() < 0 else (int(c.max()).bit_length() + 7) // 8 for c in columns]
    every = np.empty((sum(widths), len(columns[0])), np.uint8)
    for row, (c, k) in zip(every, [(c, k) for c, width in zip(columns, widths) for k in range(width)]):
        row[:] = c.view(np.uint8)[k::8]
    parts = ((b - a, np.ascontiguousarray(every[:, a:b]).reshape(-1)) for a, b in zip(bounds, bounds[1:]))
    return [n.to_bytes(4, "little") + bytes(widths) + pa.compress(part, "zstd", asbytes=True) for n, part in parts]


def planes(block, columns: int) -> list[np.ndarray]:
    """Each column's bytes in a block, lowest ones first, for ``numbers``."""
    block = memoryview(block)
    n, widths = int.from_bytes(block[:4], "little"), list(block[4 : 4 + columns])
    every = np.frombuffer(pa.decompress(block[4 + columns :], n * sum(widths), "zstd", asbytes=True), np.uint8).reshape(sum(widths), n)
    return [every[sum(widths[:k]) : sum(widths[: k + 1])] for k in range(columns)]


def numbers(column: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The whole numbers of a column of ``planes``, or those at some places."""
    some = column[:, at]
    if len(some) <= 2:
        small = some[0].astype(np.uint16) if len(some) else np.zeros(some.shape[1], np.uint16)
        return (small | some[1].astype(np.uint16) << 8 if len(some) == 2 else small).astype(np.int64)
    c = np.zeros(some.shape[1], np.int64)
    for k, plane in enumerate(some):
        c |= plane.astype(np.int64) << (8 * k)
    return c


def _turned(keys: np.ndarray, size: int, back: bool = False) -> np.ndarray:
    """Keys of ``size`` bases times an odd number, in as many bits; ``back``: what gave them."""
    by = pow(ODD, -1, 1 << 2 * size) if back else ODD % (1 << 2 * size)
    return ((keys.astype(np.uint64) * np.uint64(by)) & np.uint64((1 << 2 * size) - 1)).astype(np.int64)


def _key_blocks(batches: Iterator[pa.RecordBatch], size: int, side: int) -> Iterator[pa.RecordBatch]:
    """Batches with ``key`` -> cell, side, block: distinct keys in order, as steps from one to the next, and how often each occurs."""
    shift = max(2 * size - CELL_BITS, 0)
    held: list[np.ndarray] = []

    def flushed() -> pa.RecordBatch:
        found = np.sort(np.concatenate(held))
        held.clear()
        starts = np.nonzero(np.concatenate([[True], found[1:] != found[:-1]]))[0]
        keys, n = found[starts], np.diff(starts, append=len(found))
        cells = keys >> shift
        at = np.nonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))[0]
        steps = np.diff(keys, prepend=0)
        steps[at] = keys[at]
        bounds = [*at.tolist(), len(keys)]
        blocks = [packed(steps[a:b], n[a:b]) for a, b in zip(bounds, bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(cells[at].astype(np.int32)), pa.array(np.full(len(at), side, np.int32)), pa.array(blocks, pa.binary())], names=["cell", "side", "block"])

    for b in batches:
        held.append(_turned(b.column("key").to_numpy(), size))
        if sum(map(len, held)) >= HELD:
            yield flushed()
    if held:
        yield flushed()


def _summed(blocks: DataFrame, size: int, sides: int) -> DataFrame:
    """Blocks of keys -> key, n_0 and on: how often each key occurs on each side. A cell is summed at a time."""

    def summed(cell: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parts = [(side, *unpacked(block, 2)) for side, block in cell]
        every = np.concatenate([np.cumsum(steps) for _, steps, _ in parts])
        keys, own = np.unique(every, return_inverse=True)
        which = np.repeat([side for side, _, _ in parts], [len(n) for _, _, n in parts])
        counts = np.zeros((sides, len(keys)), np.int64)
        np.add.at(counts, (which, own), np.concatenate([n for _, _, n in parts]))
        return pa.RecordBatch.from_arrays([pa.array(_turned(keys, size, True)), *map(pa.array, counts)], names=["key", *[f"n_{k}" for k in range(sides)]])

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for b in batches:
            for cell, side, block in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "block"))):
                if cell != now and waiting:
                    yield summed(waiting)
                    waiting = []
                now = cell
                waiting.append((side, block))
        if waiting:
            yield summed(waiting)

    schema = ", ".join(["key long", *[f"n_{k} long" for k in range(sides)]])
    return blocks.repartition("cell").sortWithinPartitions("cell").mapInArrow(by_cell, schema)


def _scan(reference: DataFrame | Texts, mask: Mask, cut: Callable, side: int) -> DataFrame:
    return _scanned(reference).mapInArrow(lambda batches: _key_blocks(cut(batches), mask.size, side), "cell int, side int, block binary")


def counted_keys(reference: DataFrame | Texts, mask: Mask, repeat_masker: bool = False, space: str = "nt") -> DataFrame:
    """key, n of all seeds of ``reference``: what ``key_frequency`` tells of them, without a row for a seed."""
    cut = _cutter(mask, repeat_masker, None, space, "lead" in reference.columns, table=_table_of(reference))
    return _summed(_scan(reference, mask, cut, 0), mask.size, 1).withColumnRenamed("n_0", "n")


def counted_strands(reference: DataFrame | Texts, mask: Mask, repeat_masker: bool = False) -> DataFrame:
    """key, forward, backward: how often each key occurs in ``reference``, and on its other strand (see ``stats.turned_seeds``)."""
    chunked, table = "lead" in reference.columns, _table_of(reference)
    forward = _scan(reference, mask, _cutter(mask, repeat_masker, None, "nt", chunked, table=table), 0)
    backward = _scan(reference, mask, _cutter(Mask(mask.text[::-1]), repeat_masker, None, "nt", chunked, True, table), 1)
    return _summed(forward.unionByName(backward), mask.size, 2).toDF("key", "forward", "backward")


def counted_rows(rows: DataFrame, mask: Mask) -> DataFrame:
    """key, n of seeds that are rows already."""
    blocks = rows.select("key").mapInArrow(lambda batches: _key_blocks(batches, mask.size, 0), "cell int, side int, block binary")
    return _summed(blocks, mask.size, 1).withColumnRenamed("n_0", "n")


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """contig, pos, key of ``rows``, dealt to the buckets by key that Spark's ``hash`` tells (as a table in buckets does): a task hands on a block a bucket."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            contig, pos, key, bucket = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("contig", "pos", "key", "bucket"))
            held.clear()
            order = np.argsort(key)
            order = order[np.argsort(bucket[order], kind="stable")]
            contig, pos, key, bucket = contig[order], pos[order], key[order], bucket[order]
            at = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
            steps = np.diff(key, prepend=0)
            steps[at] = key[at]
            bounds = [*at.tolist(), len(key)]
            blocks = [packed(steps[a:b], contig[a:b], pos[a:b]) for a, b in zip(bounds, bounds[1:])]
            for k in range(0, len(at), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at[k : k + 1000]]), pa.array(blocks[k : k + 1000], pa.binary())], names=["bucket", "block"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD:
                yield from flushed()
        if held and sum(x.num_rows for x in held):
            yield from flushed()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column("block").to_pylist():
                steps, contig, pos = unpacked(block, 3)
                yield pa.RecordBatch.from_arrays([pa.array(contig), pa.array(pos.astype(np.int32)), pa.array(np.cumsum(steps))], names=["contig", "pos", "key"])

    told = rows.select("contig", "pos", "key", F.pmod(F.hash(F.col("key").cast("long")), F.lit(buckets)).alias("bucket"))
    blocks = told.mapInArrow(kept, "bucket int, block binary").repartition(buckets, "bucket")
    return blocks.select("block").mapInArrow(opened, "contig long, pos int, key long")


def likely(keys: DataFrame, n: int) -> Likely:
    """A table of the hashes of ``keys``, of which there are about ``n``: eight bits a key, up to LIKELY bits in all. Each task hands on a block of hashes for each
    part of the table, and a part is filled by one task."""
    bits = min(LIKELY, max(CELL_BITS + 3, (8 * n).bit_length()))
    part = bits - CELL_BITS

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            found = np.unique(np.concatenate(held)).astype(np.int64)
            held.clear()
            cells = found >> part
            at = np.nonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))[0]
            steps = np.diff(found, prepend=0)
            steps[at] = found[at] & ((1 << part) - 1)
            bounds = [*at.tolist(), len(found)]
            return pa.RecordBatch.from_arrays([pa.array(cells[at].astype(np.int32)), pa.array([packed(steps[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["cell", "block"])

        for b in batches:
            if b.num_rows:
                held.append(Likely.hashed(b.column("key").to_numpy(), bits))
            if sum(map(len, held)) >= HELD:
                yield flushed()
        if held:
            yield flushed()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, there = None, np.zeros(1 << part, bool)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())], names=["cell", "block"])
        for b in batches:
            for cell, block in zip(b.column("cell").to_pylist(), b.column("block").to_pylist()):
                if cell != now and now is not None:
                    yield done()
                    there[:] = False
                now = cell
                there[np.cumsum(unpacked(block, 1)[0])] = True
        if now is not None:
            yield done()

    kind = "cell int, block binary"
    rows = keys.select("key").mapInArrow(hashes, kind).repartition("cell").sortWithinPartitions("cell").mapInArrow(filled, kind).toArrow()
    table = np.zeros((1 << CELL_BITS, 1 << part - 3), np.uint8)
    for cell, block in zip(rows.column("cell").to_pylist(), rows.column("block").to_pylist()):
        table[cell] = np.frombuffer(block, np.uint8)
    return Likely(table.reshape(-1), bits)


def _sorted_by_key(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The order of keys, turned, and in it: the distinct ones as steps within their cell, how often each occurs, the cells, and where each cell's keys begin."""
    key = _turned(key, size)
    order = np.argsort(key)
    key = key[order]
    starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    n, key = np.diff(starts, append=len(key)), key[starts]
    cells = key >> max(2 * size - CELL_BITS, 0)
    at = np.nonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))[0]
    steps = np.diff(key, prepend=0)
    steps[at] = key[at]
    return order, steps, n, cells[at].astype(np.int32), [*at.tolist(), len(key)]


def _row_blocks(batches: Iterator[pa.RecordBatch], size: int, side: int, columns: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of whole numbers with ``key`` -> cell, side, block, rows: distinct keys and how often each occurs, and ``columns`` in the order of the keys; with
    ``most``, without the rows of keys that occur oftener."""
    held: list[list[np.ndarray]] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        key, *own = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, steps, n, cells, bounds = _sorted_by_key(key, size)
        rows = n if most is None else np.where(n <= most, n, 0)
        order = order[np.repeat(rows > 0, n)]
        upto = np.concatenate([[0], np.cumsum(rows)])[bounds].tolist()
        own = [c[order] for c in own]
        for k in range(0, len(cells), 1000):
            some = list(zip(bounds[k : k + 1001], bounds[k + 1 : k + 1001]))
            blocks = [packed(steps[a:b], n[a:b]) for a, b in some]
            places = [packed(*(c[a:b] for c in own)) for a, b in zip(upto[k : k + 1000], upto[k + 1 : k + 1001])]
            yield pa.RecordBatch.from_arrays([pa.array(cells[k : k + 1000]), pa.array(np.full(len(some), side, np.int32)), pa.array(blocks, pa.binary()), pa.array(places, pa.binary())], names=["cell", "side", "block", "rows"])

    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy() for c in ("key", *columns)])
        if sum(len(x[0]) for x in held) >= HELD // 2:
            yield from flushed()
    if held:
        yield from flushed()


def met(reference: DataFrame | Texts, keys: DataFrame, mask: Mask, carried: list[str], most: int, repeat_masker: bool = False, space: str = "nt", sought=None) -> DataFrame:
    """keys (key, and the whole numbers ``carried``) with the seeds of ``reference``: each row of ``keys`` whose key occurs, with ``n``, how often, and where
    (arrays ``contigs`` and ``places``; null if oftener than ``most``).

    Seeds and keys meet in their cell, as blocks; a task doesn't hand on the places of a key that it alone holds oftener than ``most``. ``sought`` (see ``seeds``) may let
    through seeds whose key isn't among ``keys``: they are settled here.
    """
    size, cut = mask.size, _cutter(mask, repeat_masker, sought, space, "lead" in reference.columns, table=_table_of(reference))
    kind = "cell int, side int, block binary, rows binary"
    seeds_ = _scanned(reference).mapInArrow(lambda batches: _row_blocks(cut(batches), size, 0, ["contig", "pos"], most), kind)
    asked = keys.select("key", *carried).mapInArrow(lambda batches: _row_blocks(batches, size, 1, carried), kind)

    def joined(cell: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for side, block, rows in cell:
            steps, n = unpacked(block, 2)
            sides[side].append((np.cumsum(steps), n, *unpacked(rows, 2 if side == 0 else len(carried))))
        if not all(sides):
            return
        (key, n, contig, pos), (wanted, times, *own) = ([np.concatenate(x) for x in zip(*s)] for s in sides)
        distinct, which = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
        there = distinct[at] == key
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at[there], n[there])
        # Places of the keys that are wanted and seldom enough, by key.
        rows = np.where(n <= most, n, 0)
        few = there & (total[at] <= most)
        kept, of = np.repeat(few, rows), np.repeat(at, rows)
        order = np.argsort(of[kept], kind="stable")
        contig, pos = contig[kept][order], pos[kept][order].astype(np.int32)
        each = np.where(total <= most, total, 0)
        first, which = np.cumsum(each) - each, np.repeat(which, times)
        every = np.nonzero(total[which] > 0)[0]
        for k in range(0, len(every), 1 << 14):
            some = every[k : k + (1 << 14)]
            own_key = which[some]
            length = each[own_key]
            ends = np.cumsum(length)
            picked = np.repeat(first[own_key] - ends + length, length) + np.arange(ends[-1])
            bounds = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(c[picked])) for c in (contig, pos)]
            lists = [pc.if_else(pa.array(length > 0), x, pa.scalar(None, x.type)) for x in lists]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in own), pa.array(total[own_key]), *lists], names=[*carried, "n", "contigs", "places"])

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for b in batches:
            for cell, side, block, rows in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "block", "rows"))):
                if cell != now and waiting:
                    yield from joined(waiting)
                    waiting = []
                now = cell
                waiting.append((side, block, rows))
        if waiting:
            yield from joined(waiting)

    schema = ", ".join([*[f"{c} long" for c in carried], "n long", "contigs array<long>", "places array<int>"])
    return seeds_.unionByName(asked).repartition("cell").sortWithinPartitions("cell").mapInArrow(by_cell, schema)
