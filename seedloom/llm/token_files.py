"""Token ids in files of fixed-width bit packing, as a PySpark data source.

An id takes as many bits as the vocabulary needs and no more. A file is a run of blocks of ids, then a footer with where each
block begins, its checksum, and where each document ends, so that numpy unpacks a whole block at once and any
document or range of ids is read without what lies before it. Files are opened through pyarrow's file systems.

A file: ``MAGIC``; the blocks, each packed from the lowest bit of its first byte on; the footer; the footer's length (8 bytes) and
``MAGIC`` again. The footer: bits an id, ids a block, numbers of ids, documents and blocks (8 bytes each); of each block its offset (8)
and CRC-32 (4); of each document its id (8), its end among the file's ids (8), and 1 if its id is null (1). All are little-endian.
A folder's manifest names its files in order: only what it names was committed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import located, scratch

MAGIC = b"LOOMBITS"
MANIFEST = "_manifest.json"
SCHEMA = "doc_id long, start long, ids binary"
#: Ids of a block, and the most ids and documents of a file: what a task holds at once is a block, a document and a footer.
BLOCK, FILE_IDS, FILE_DOCS = 1 << 16, 1 << 26, 1 << 20
#: Words that a worker remembers (those of late, and as many of before), and, about, chunks.
MOST_WORDS = 400_000


# Packing


def width_of(vocabulary: int) -> int:
    """Bits that ids below ``vocabulary`` need; 1 at least."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, width: int) -> bytes:
    """``ids`` (each below 2**width, width up to 32) one after the other in ``width`` bits, the lowest first; the last byte is filled with 0."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    n = len(ids)
    eight = np.zeros((-(-n // 8), 8), np.uint64)  # 8 ids take ``width`` whole bytes
    eight.reshape(-1)[:n] = ids
    out = np.zeros((len(eight), width), np.uint8)
    for k in range(8):
        first, shift = divmod(k * width, 8)
        moved = eight[:, k] << np.uint64(shift)
        for j in range(-(-(shift + width) // 8)):
            out[:, first + j] |= (moved >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()[: -(-n * width // 8)]


def unpacked(data: bytes, width: int, n: int, skip: int = 0) -> np.ndarray:
    """Ids ``skip`` to ``skip + n`` of what ``packed`` made, as unsigned 32-bit numbers."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, skip * width // 8).astype("<u4")
    raw = np.frombuffer(data + b"\0" * 5, np.uint8)
    bit = np.arange(skip, skip + n, dtype=np.int64) * width
    at, value = bit >> 3, np.zeros(n, np.uint64)
    for j in range(-(-(7 + width) // 8)):
        value |= raw[at + j].astype(np.uint64) << np.uint64(8 * j)
    return ((value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


# Files


def opened(uri: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class FileWriter:
    """One file: documents go in, blocks go out as they fill."""

    def __init__(self, out, width: int, block: int):
        self.out, self.width, self.block = out, width, block
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.offset = len(MAGIC)
        self.blocks: list[tuple[int, int]] = []
        self.names: list[int | None] = []
        self.ends: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id needs more than {self.width} bits")
        self.ids += len(ids)
        self.names.append(doc_id)
        self.ends.append(self.ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            every, at = np.concatenate(self.held), 0
            while len(every) - at >= self.block:
                self._block(every[at : at + self.block])
                at += self.block
            self.held, self.waiting = [every[at:]], len(every) - at

    def _block(self, ids: np.ndarray) -> None:
        data = packed(ids, self.width)
        self.blocks.append((self.offset, zlib.crc32(data)))
        self.out.write(data)
        self.offset += len(data)

    def close(self) -> dict:
        """Write the rest; what the manifest says of the file."""
        if self.waiting:
            self._block(np.concatenate(self.held))
        known = [x for x in self.names if x is not None]
        footer = np.array([self.width, self.block, self.ids, len(self.names), len(self.blocks)], "<i8").tobytes()
        footer += np.array([b[0] for b in self.blocks], "<i8").tobytes() + np.array([b[1] for b in self.blocks], "<u4").tobytes()
        footer += np.array([x or 0 for x in self.names], "<i8").tobytes() + np.array(self.ends, "<i8").tobytes() + bytes(x is None for x in self.names)
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return {"ids": self.ids, "docs": len(self.names), "least": min(known, default=None), "most": max(known, default=None)}


class TokenFile:
    """Random access to one file."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        tail = self._bytes(size - 16, 16)
        if tail[8:] != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError("not a file of packed ids")
        length = int.from_bytes(tail[:8], "little")
        footer = self._bytes(size - 16 - length, length)
        self.width, self.block, self.ids, docs, blocks = (int(x) for x in np.frombuffer(footer, "<i8", 5))
        at = 40
        self.offsets = np.append(np.frombuffer(footer, "<i8", blocks, at), size - 16 - length)
        self.sums = np.frombuffer(footer, "<u4", blocks, at := at + 8 * blocks)
        self.names = np.frombuffer(footer, "<i8", docs, at := at + 4 * blocks)
        self.ends = np.frombuffer(footer, "<i8", docs, at := at + 8 * docs)
        self.null = np.frombuffer(footer, bool, docs, at + 8 * docs)
        self.last: tuple[int, np.ndarray] | None = None

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) < n:
            raise EOFError("a file of packed ids ends early")
        return data

    def _block(self, k: int) -> np.ndarray:
        if self.last is None or self.last[0] != k:
            data = self._bytes(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
            if zlib.crc32(data) != self.sums[k]:
                raise ValueError(f"block {k} differs from its checksum")
            self.last = (k, unpacked(data, self.width, min(self.block, self.ids - k * self.block)))
        return self.last[1]

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: only the blocks that hold them are read."""
        if not 0 <= start <= stop <= self.ids:
            raise IndexError(f"ids {start} to {stop} of {self.ids}")
        parts = []
        while start < stop:
            k, at = divmod(start, self.block)
            n = min(stop - start, self.block - at)
            parts.append(self._block(k)[at : at + n])
            start += n
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """Id, start in the file, and ids of document ``i``."""
        start = int(self.ends[i - 1]) if i else 0
        return None if self.null[i] else int(self.names[i]), start, self.range(start, int(self.ends[i]))


def manifest(store, root: str) -> dict | None:
    from pyarrow import fs

    path = f"{root.rstrip('/')}/{MANIFEST}"
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


# The source


@dataclass
class Files(InputPartition):
    """Names and sizes of neighbouring files, and how many ids lie before each."""

    files: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[dict]


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.target_bytes = options["path"], int(options.get("partitionbytes", 64 << 20))
        self.low: int | None = None
        self.high: int | None = None
        self.among: set[int] | None = None
        self.bound = False

    def pushFilters(self, filters: list[Filter]):
        """Filters on doc_id leave out files by the manifest, and documents by the footer."""
        for f in filters:
            if getattr(f, "attribute", None) != ("doc_id",) or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                yield f
                continue
            self.bound = True
            if isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.among = some if self.among is None else self.among & some
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(self.low, low)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)

    def _overlaps(self, f: dict) -> bool:
        if not self.bound:
            return True
        if f["least"] is None:
            return False
        return not (self.low is not None and f["most"] < self.low or self.high is not None and f["least"] > self.high) and (
            self.among is None or any(f["least"] <= x <= f["most"] for x in self.among)
        )

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        found = manifest(store, root)
        if found is None:
            raise ValueError(f"no packed ids at {self.path}")
        groups: list[tuple[int, list]] = []
        before = 0
        for f in found["files"]:
            if self._overlaps(f):
                if groups and groups[-1][0] + f["bytes"] <= self.target_bytes:
                    groups[-1] = (groups[-1][0] + f["bytes"], [*groups[-1][1], (f["name"], f["bytes"], before)])
                else:
                    groups.append((f["bytes"], [(f["name"], f["bytes"], before)]))
            before += f["ids"]
        return [Files(files) for _, files in groups] or [Files([])]

    def _wanted(self, file: TokenFile) -> np.ndarray:
        if not self.bound:
            return np.arange(len(file.names))
        good = ~file.null
        if self.low is not None:
            good &= file.names >= self.low
        if self.high is not None:
            good &= file.names <= self.high
        if self.among is not None:
            good &= np.isin(file.names, list(self.among))
        return np.nonzero(good)[0]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        for name, size, before in partition.files:
            with store.open_input_file(f"{root.rstrip('/')}/{name}") as source:
                file = TokenFile(source, size)
                names, starts, held, n = [], [], [], 0
                for i in self._wanted(file).tolist():
                    doc_id, start, ids = file.document(i)
                    names.append(doc_id)
                    starts.append(before + start)
                    held.append(ids.tobytes())
                    n += len(ids)
                    if n >= 1 << 20 or len(names) >= 10_000:
                        yield _rows(names, starts, held)
                        names, starts, held, n = [], [], [], 0
                yield _rows(names, starts, held)


def _rows(names: list, starts: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])


class TokenWriter(DataSourceArrowWriter):
    """Rows (doc_id, ids), or (doc_id, text) to be encoded, in the order in which tasks and their rows come; a new file begins where one is full.

    A file's name is its attempt's own, and the manifest, written last, names those of the tasks that committed.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.tokenizer, self.end = options.get("tokenizer"), int(options.get("end", 0))
        size = options.get("vocabulary") or max(chunk_ids(self.tokenizer).size, self.end + 1)
        self.width = width_of(int(size))
        self.block, self.file_ids, self.file_docs = int(options.get("block", BLOCK)), int(options.get("fileids", FILE_IDS)), int(options.get("filedocs", FILE_DOCS))
        if self.width > 32:
            raise ValueError("a vocabulary has up to 2**32 ids")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        root, part = root.rstrip("/"), TaskContext.get().partitionId()
        files, now, name = [], None, ""

        def closed() -> None:
            size = {"name": name, **now.close()}
            files.append({**size, "bytes": store.get_file_info(f"{root}/{name}").size})

        for b in batches if self.tokenizer is None else encoded_batches(batches, self.tokenizer, self.end):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                ids = np.frombuffer(ids.as_py() or b"", "<u4")
                if now is not None and (now.ids + len(ids) > self.file_ids or len(now.names) >= self.file_docs):
                    closed()
                    now = None
                if now is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.ids"
                    now = FileWriter(store.open_output_stream(f"{root}/{name}", compression=None), self.width, self.block)
                now.add(doc_id, ids)
        if now is not None:
            closed()
        return Written(part, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        before = manifest(store, root)
        new = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.part) for f in m.files]
        if before and not self.overwrite and before["width"] != self.width:
            raise ValueError(f"the files there have {before['width']} bits an id")
        old = before["files"] if before else []
        with store.open_output_stream(f"{root.rstrip('/')}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"width": self.width, "files": new if self.overwrite else [*old, *new]}).encode())
        if self.overwrite:
            for f in old:
                store.delete_file(f"{root.rstrip('/')}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{root.rstrip('/')}/{f['name']}")


class TokenSource(DataSource):
    """``spark.read.format("token_ids").load(folder)``: doc_id, start (ids of all documents before it), ids (unsigned 32-bit, little-endian).

    Writing takes rows doc_id, ids with the option vocabulary (number of ids), or rows doc_id, text with the options tokenizer (path) and end (id
    after each text); others: block (ids), fileIds, fileDocs. Append puts files behind those there.
    Reading: partitionBytes. Filters on doc_id are pushed down.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(TokenSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def as_array(ids: Column) -> Column:
    """Binary ids as an array of long."""
    one = lambda i: F.conv(F.hex(F.reverse(F.substring(ids, i * 4 + 1, F.lit(4)))), 16, 10).cast("long")
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


# Encoding


#: Letters of the tokenizer's first cut that need no table: ASCII, and those of the Latin blocks.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: White space of that cut, which leaves out four separators that Python counts, and all else.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"


class ChunkIds:
    """Ids of a text as the tokenizer (a byte-level BPE) gives them, as little-endian unsigned 32-bit bytes.

    Its first cut always parts a text before a space between two characters that aren't white space, and after a run of letters. So a text's
    ids are those of its words, each with the space before it, in turn, and a word's those of its chunks; words and chunks are encoded once
    while they are remembered. A text with other white space at a word's edge is cut by ``CHUNK`` throughout, and one that
    holds a special token is encoded whole.
    """

    #: A run of letters and the space before it, with something else in ASCII or nothing behind it, is one piece of the first cut.
    CHUNK = re.compile(rf" ?[{LATIN}]+(?=[\x00-@\[-`{{-\x7f]|\Z)| ?{OTHER}+|{SPACE}+(?!{OTHER})|{SPACE}+")
    PIECE = re.compile(rf" ?[{LATIN}]+\Z")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own) if b != 10}  # line ends part pieces below
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}  # None: has white space at an edge
        self.before: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn_chunks(self, chunks: list[str]) -> None:
        if len(self.chunks) >= MOST_WORDS:
            self.chunks.clear()
        new = set(chunks).difference(self.chunks)
        plain, pieces = [], []
        for c in new:
            if c.removeprefix(" ").isalpha():
                if c.isascii():
                    plain.append(c)
                elif self.PIECE.match(c):
                    pieces.append(c)
        # Letters of ASCII stand for themselves.
        told = "\n".join(plain).replace(" ", "Ġ").split("\n") + "\n".join(pieces).encode().decode("latin-1").translate(self.letters).split("\n")
        if not plain or not pieces:
            told.remove("")
        pieces = plain + pieces
        tokenize = self.model.tokenize
        for c, piece in zip(pieces, told):
            self.chunks[c] = array("I", [t.id for t in tokenize(piece)]).tobytes()
        rest = list(new.difference(pieces))
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.chunks[c] = array("I", e.ids).tobytes()

    def _cut(self, text: str) -> bytes:
        chunks = self.CHUNK.findall(text)
        self._learn_chunks(chunks)
        return b"".join(map(self.chunks.__getitem__, chunks))

    def learn(self, words: set[str]) -> None:
        """Remember ``words``, which follow a space; the memory of words may begin anew."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > MOST_WORDS:
            self.before, self.words, new = self.words, {}, words
        fresh = []
        for w in new:
            if w in self.before:
                self.words[w] = self.before[w]
            elif w and w.strip() == w:
                fresh.append(w)
            else:
                self.words[w] = None
        for at in range(0, len(fresh), MOST_WORDS):
            some = fresh[at : at + MOST_WORDS]
            chunks = self.CHUNK.findall("".join([f" {w}" for w in some]))
            self._learn_chunks(chunks)
            parts = list(map(self.chunks.__getitem__, chunks))
            begins = [i for i, c in enumerate(chunks) if c[0] == " "]
            for w, i, j in zip(some, begins, [*begins[1:], len(chunks)]):
                self.words[w] = parts[i] if j == i + 1 else b"".join(parts[i:j])

    def of_texts(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        self.learn(set().union(*[p[1:] for p in parts]))
        known, out = self.words.__getitem__, []
        for text, words in zip(texts, parts):
            first = words[0]
            if self.special and self.special.search(text):
                out.append(self._whole(text))
            elif not first or first.strip() != first:
                out.append(self._cut(text))
            else:
                try:
                    out.append(b"".join([self._cut(first), *map(known, words[1:])]))
                except TypeError:  # a None
                    out.append(self._cut(text))
        return out


_COPIES: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One copy for each worker process, which outlives its tasks."""
    if path not in _COPIES:
        _COPIES[path] = ChunkIds(path)
    return _COPIES[path]


#: Characters of texts whose chunks are looked up together.
TOGETHER = 1 << 20


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs in ascending order of doc_id over partitions and within them; nulls last.

    Rows of one id are told apart by their texts' hash and where they lie, so that a range may end between them: an id that many rows have isn't one task's.
    """
    rows = located(docs, "token-texts", ["doc_id", "text"])
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("_file", "_row").alias("_at"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_at")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def encoded_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    """Batches with doc_id and text -> doc_id, start (0), ids (with ``end`` after them), row by row. A null text is empty."""
    coder, last = chunk_ids(tokenizer), end.to_bytes(4, "little")
    for b in batches:
        names, texts, some, size = b.column("doc_id").to_pylist(), b.column("text"), [], 0
        for i in range(b.num_rows):
            some.append(texts[i].as_py() or "")
            size += len(some[-1])
            if size >= TOGETHER or i + 1 == b.num_rows:
                ids = [x + last for x in coder.of_texts(some)]
                yield _rows(names[i + 1 - len(ids) : i + 1], [0] * len(ids), ids)
                some, size = [], 0


def encoded(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start (0), ids (with ``end`` after them), row by row."""
    return docs.mapInArrow(lambda batches: encoded_batches(batches, tokenizer, end), SCHEMA)


def write_ids(rows: DataFrame, path: str, **options) -> None:
    """Write rows (doc_id, ids; or doc_id, text) to files in the order in which they lie; options as those of ``TokenSource``."""
    registered(rows.sparkSession)
    rows.write.format("token_ids").options(**options).mode("append").save(path)


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = 0, **options) -> DataFrame:
    """Encode docs (doc_id, text), write their ids to ``folder`` in ascending doc_id order, and read the files: doc_id, start, ids.

    * Texts are dealt by ranges of doc_id and encoded by the task that writes their file: ids take more room than their text until they are packed, so
      nothing but texts is shuffled, and ids never leave the task but in its file.
    * A null or empty text is ``end`` alone. Null doc_ids come last. An empty table makes no file but the manifest, and gives no rows.
    * A special token's name in a text is that token, as the tokenizer takes it by default.
    * Other columns of ``docs`` aren't read.
    """
    spark = docs.sparkSession
    registered(spark)
    folder = folder or scratch(spark, "token-ids")
    write_ids(in_order(docs), folder, tokenizer=tokenizer, end=end, **options)
    return spark.read.format("token_ids").load(folder)


def digests(back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents as the source reads them."""
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
