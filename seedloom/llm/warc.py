"""WARC archives as a PySpark data source, and writing pages to deduplicated archives.

Reading plans one partition per group of files, reads the named fields of each record first,
tests the pushed filters on them, and only then touches the payload: an unwanted record's
bytes are passed over without being decoded. Files are opened through pyarrow's file systems,
so a folder may be local, on HDFS or in an object store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import scratch, stored

#: Field names of the WARC 1.1 format.
TYPE, RECORD_ID, TARGET, DATE, LENGTH = "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "Content-Length"
DIGEST, REFERS = "WARC-Payload-Digest", "WARC-Refers-To"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An extension field: bytes of the payload that a revisit record stands for.
FULL_LENGTH = "X-Payload-Length"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, content_type string, payload string"
#: Columns that pushed filters may name, by the field that holds them.
FIELDS = {"record_type": TYPE, "record_id": RECORD_ID, "target_uri": TARGET, "date": DATE, "payload_digest": DIGEST, "refers_to": REFERS, "content_type": "Content-Type"}


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: 160 bits are 32 letters of 5 bits."""
    digest = F.sha1(data)

    def letters(i: int) -> list[Column]:
        twenty = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(twenty, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[x for i in range(8) for x in letters(i)])


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, (LENGTH, str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The fields of the next record, or None at the end. Names are told apart without case; long lines may be folded."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    last = ""
    while (line := stream.readline()).strip(b"\r\n"):
        if line[:1] in b" \t" and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().decode("utf-8", "replace").lower()
        found[last] = value.strip().decode("utf-8", "replace")
    return found


def _passed(stream: io.BufferedIOBase, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise EOFError("a record ends before its Content-Length")
        n -= got


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    staged: str | None
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target_bytes = int(options.get("partitionbytes", 64 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.skip = options.get("malformed", "fail").lower() == "skip"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo):
                self.tests.append((FIELDS[name].lower(), "eq", f.value))
            elif name in FIELDS and isinstance(f, In):
                self.tests.append((FIELDS[name].lower(), "in", frozenset(f.value)))
            elif name in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((FIELDS[name].lower(), "starts", f.value))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.tests.append((FIELDS[name].lower(), "some", None))
            else:
                yield f

    def wanted(self, fields: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            x = fields.get(name)
            if x is None or kind == "eq" and x != value or kind == "in" and x not in value or kind == "starts" and not x.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Files in order of size, dealt into groups of about ``partitionbytes``."""
        from pyarrow import fs

        store, root = _opened(self.path)
        every = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(((x.size, x.path) for x in every if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))), reverse=True)
        groups: list[tuple[int, list[str]]] = []
        for size, path in files:
            if groups and groups[-1][0] + size <= self.target_bytes:
                groups[-1] = (groups[-1][0] + size, [*groups[-1][1], path])
            else:
                groups.append((size, [path]))
        return [Files(paths) for _, paths in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as raw:
                buffered = io.BufferedReader(raw, 1 << 16)
                stream = gzip.GzipFile(fileobj=buffered) if path.endswith(".gz") else buffered
                try:
                    yield from self.records(stream)
                except (ValueError, EOFError, OSError) as error:
                    if not self.skip:
                        raise ValueError(f"{path}: {error}") from error

    def records(self, stream) -> Iterator[tuple]:
        """Records of an archive, until one that is malformed: a length that is no number, or a payload that ends early, or differs from its digest."""
        while (fields := headers(stream)) is not None:
            length, wanted, body = int(fields.get(LENGTH.lower(), 0)), self.wanted(fields), None
            if length < 0:
                raise ValueError("a length below 0")
            if not wanted or not (self.payload or self.verify):
                _passed(stream, length)
            else:
                body = stream.read(length)
                if len(body) < length:
                    raise ValueError("a payload ends early")
                digest = fields.get(DIGEST.lower()) or ""
                if self.verify and fields.get(TYPE.lower()) != "revisit" and digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(body).digest()).decode():
                    raise ValueError("a payload differs from its digest")
            if wanted:
                yield self.row(fields, length, body if self.payload else None)

    def row(self, fields: dict[str, str], length: int, body: bytes | None) -> tuple:
        full = fields.get(FULL_LENGTH.lower())
        revisit = fields.get(TYPE.lower()) == "revisit"
        digest = fields.get(DIGEST.lower())
        return (
            fields.get(TYPE.lower()),
            fields.get(RECORD_ID.lower()),
            fields.get(TARGET.lower()),
            fields.get(DATE.lower()),
            digest,
            fields.get(REFERS.lower()),
            int(full) if full else None if revisit else length,
            fields.get("content-type"),
            None if body is None or revisit else body.decode("utf-8", "replace"),
        )


class WarcWriter(DataSourceWriter):
    """Rows of the source's schema to one archive per task, each record a gzip member of its own.

    A task writes to a name of its own attempt; only what tasks committed gets its final name.
    """

    def __init__(self, options: dict, names: list[str], overwrite: bool = False):
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.suffix = ".warc" if options.get("compression", "gzip") == "none" else ".warc.gz"

    def write(self, rows: Iterator) -> Written:
        store, root = _opened(self.path)
        path, n, out = f"{root.rstrip('/')}/part-{uuid.uuid4().hex}{self.suffix}", 0, None
        try:
            for row in rows:
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{path}.staged", compression=None)
                data = self.record(row)
                out.write(gzip.compress(data, 6, mtime=0) if self.suffix.endswith(".gz") else data)
                n += 1
        finally:
            if out is not None:
                out.close()
        return Written(path if n else None, f"{path}.staged" if n else None, n)

    def record(self, row) -> bytes:
        body = b"" if row.payload is None else row.payload.encode()
        fields = [(TYPE, row.record_type), (RECORD_ID, row.record_id), (DATE, row.date)]
        clean = (lambda x: x.replace("\r", "%0D").replace("\n", "%0A"))
        fields += [(k, clean(v)) for k, v in ((TARGET, row.target_uri), (DIGEST, row.payload_digest), (REFERS, row.refers_to), ("Content-Type", row.content_type)) if v is not None]
        if row.record_type == "revisit":
            fields += [("WARC-Profile", PROFILE), (FULL_LENGTH, str(row.payload_bytes))]
            body = b""
        return record_bytes(fields, body)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        if self.overwrite:
            from pyarrow import fs

            for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if x.is_file and x.base_name.endswith((".warc", ".warc.gz")):
                    store.delete_file(x.path)
        for m in messages:
            if m is not None and m.path:
                store.move(m.staged, m.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.path)
        for m in messages:
            if m is not None and m.staged:
                store.delete_file(m.staged)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: payload (true/false), partitionBytes, verify (true: payloads are held
    against their digests), malformed (fail, or skip: the rest of an archive after a malformed record is left out). Writing: compression (gzip/none)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema.names, overwrite)


def registered(spark) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def page_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*)>$", 1), F.lit("")).cast("long")


def records(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) as rows of the source's schema, equal payloads as revisits of the smallest page_id.

    * A null html is the empty payload; payloads shorter than ``least_bytes`` are never revisits.
    * Rows that share payload and the smallest id are all responses. Null ids count as the largest.
    * An empty table gives no records.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    data = payload.cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(data, 256).alias("_equal"))
    # Only payloads that occur twice are joined back: few rows, so that Spark can broadcast them once it has counted them.
    groups = rows.groupBy("_equal").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.first("payload_bytes").alias("_bytes"))
    again = stored(groups.where((F.col("_n") > 1) & (F.col("_bytes") >= least_bytes) & F.col("_first").isNotNull()).select("_equal", "_first"), "warc-revisits")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(again, "_equal", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        page_urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), base32_sha1(data_of("payload"))).alias("payload_digest"),
        F.when(revisit, page_urn(F.col("_first"))).alias("refers_to"),
        "payload_bytes",
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def data_of(name: str) -> Column:
    return F.col(name).cast("binary")


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives under ``folder`` and read them: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    registered(spark)
    folder = folder or scratch(spark, "warc")
    records(pages, least_bytes).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").option("payload", "false").load(folder)
    return back.where(F.col("record_type").isin("response", "revisit")).select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
