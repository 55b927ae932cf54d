"""FASTA and FASTQ files, and conversions of instruments' files, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import normalised, reverse_complement
from ..storage import stored
from .fastq import read_fastq

__all__ = ["read_fastq"]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig (from 1, in file order), name (up to white space), seq (lines joined, U as T, ambiguity as N)."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "^>", "")
    # Within a file, records of one split follow each other: file, where the split begins, and the record's number in it give file order.
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    rows = records.select(where.alias("_at"), F.regexp_extract(body, r"^([^\s]*)", 1).alias("name"), normalised(F.regexp_replace(F.regexp_extract(body, r"(?s)^[^\n]*\n?(.*)$", 1), r"\s", "")).alias("seq"))
    # Contigs are few beside bases: they are numbered on their places alone.
    numbers = rows.select("_at").withColumn("contig", F.row_number().over(Window.orderBy("_at")).cast("long"))
    return rows.join(numbers, "_at").select("contig", "name", "seq")


def write_fasta(reference: DataFrame, path: str) -> None:
    reference.orderBy("contig").select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq"))).write.text(path)


def write_fastq(reads: DataFrame, path: str, width: int = 0) -> None:
    """Reads (name, seq, qual) as FASTQ; with ``width`` sequences and qualities are cut into lines of so many letters."""
    cut = lambda c: F.regexp_replace(c, f"(?s)(.{{{width}}})(?=.)", "$1\n") if width else F.col(c)
    reads.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), cut("seq"), F.lit("\n+\n"), cut("qual"))).write.text(path)


def in_parts(rows: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and written, with ``_part``, the number of their range."""
    return stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)


def grouped_ends(rows: DataFrame, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Consecutive rows of one name are the ends of a read: adds group (from 1 in its partition) and end_no (from 1).

    Rows are dealt by ranges of ``partition`` and ``order`` (a file, a lane, a place in it), and runs of one name are told within each. Of each range only its first and
    last run is gathered: what lies before it tells how many groups were begun, and how many rows of its first run. So a lane, or a file, is many
    tasks' work. Null names are one name.
    """
    lane = [F.col(c) for c in partition]
    dealt = in_parts(rows, [*lane, *[F.col(c) for c in order]], "ends")
    inside = Window.partitionBy("_part").orderBy(*lane, *order)
    named = F.struct(*lane, F.col("name"))
    first = F.row_number().over(inside) == 1
    told = dealt.withColumn("_new", (~first & ~F.lag(named).over(inside).eqNullSafe(named)).cast("int"))
    told = told.withColumn("_run", F.sum("_new").over(inside)).withColumn("_n", F.row_number().over(Window.partitionBy("_part", "_run").orderBy(*lane, *order)))
    told = stored(told.withColumn("_named", named), "runs")
    runs = told.groupBy("_part", "_run").agg(F.count(F.lit(1)).alias("rows"), F.first("_named").alias("named"))
    ends = runs.groupBy("_part").agg(F.max("_run").alias("last"), F.max_by("rows", "_run").alias("rows"), F.max_by("named", "_run").alias("last_named"), F.min_by("named", "_run").alias("first_named"))
    # One row a range from here on.
    along = Window.orderBy("_part")
    goes_on = F.coalesce(F.lag("last_named").over(along).eqNullSafe(F.col("first_named")) & (F.row_number().over(along) > 1), F.lit(False)).cast("int")
    ends = ends.withColumn("goes_on", goes_on)
    begun = F.coalesce(F.sum(F.col("last") + 1 - F.col("goes_on")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("_base", begun - F.col("goes_on") + 1).withColumn("_last", F.col("_base") + F.col("last"))
    # Rows that earlier ranges hold of the run that goes on: those whose last run has the number of this one's first.
    held = ends.select(F.col("_last").alias("_base"), F.col("_part").alias("_from"), F.col("rows").alias("_held"))
    carried = ends.where("goes_on = 1").select("_part", "_base").join(held, "_base").where(F.col("_from") < F.col("_part")).groupBy("_part").agg(F.sum("_held").alias("_carried"))
    starts = ends.select("_part", "_base").join(carried, "_part", "left").withColumn("_carried", F.coalesce("_carried", F.lit(0)))
    joined = told.join(F.broadcast(starts), "_part")
    end_no = F.col("_n") + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)
    joined = joined.withColumn("group", (F.col("_base") + F.col("_run")).cast("long")).withColumn("end_no", end_no.cast("int"))
    joined = joined.drop("_part", "_new", "_run", "_n", "_named", "_base", "_carried")
    if not partition:
        return joined
    least = stored(runs.join(F.broadcast(starts), "_part").select("_part", (F.col("_base") + F.col("_run")).alias("g"), F.col("named")).select(*[F.col(f"named.{c}").alias(c) for c in partition], "g").groupBy(*partition).agg(F.min("g").alias("_least")), "lanes")
    on = [joined[c].eqNullSafe(least[c]) for c in partition]
    return joined.join(least, on).select(*[joined[c] for c in joined.columns if c not in ("group", "end_no")], (F.col("group") - F.col("_least") + 1).alias("group"), "end_no")


def with_number(rows: DataFrame, order: Sequence[str | Column], end: int | None = None) -> DataFrame:
    """Rows with their number n in order, from 1; with ``end``, of the ranges that begin up to it alone.

    Rows are dealt by ranges of ``order`` and numbered within each; only the number of rows before each range is gathered. Rows equal in ``order`` are
    numbered in any order.
    """
    dealt = in_parts(rows, order, "numbered")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    near = dealt.join(F.broadcast(before if end is None else before.where(F.col("_before") < end)), "_part")  # a row for each range
    return near.withColumn("n", (F.col("_before") + own).cast("long")).drop("_part", "_before")


def numbered(rows: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (from 1, inclusive) in order, with their number n."""
    return with_number(rows, order, end).where(F.col("n").between(start, end))


def split_every(reads: DataFrame, each: int) -> DataFrame:
    """Reads (name, ...) with their number n in the natural order of their names, and ``file``, from 1: each file has ``each`` reads but the last."""
    key = natural_key(F.col("name"))
    return with_number(reads.withColumn("_key", key), ["_key", "name"]).drop("_key").withColumn("file", F.expr(f"(n - 1) div {int(each)} + 1"))


def write_split(reads: DataFrame, each: int, path: str) -> None:
    """FASTQ files of ``each`` reads (name, seq, qual), in folders ``file=1`` and on, in the natural order of names."""
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value")
    whole = split_every(reads, each).repartitionByRange("file").sortWithinPartitions("file", "n")
    whole.select("file", record).write.partitionBy("file").text(path)


def color_reads(bases: DataFrame, qualities: DataFrame) -> DataFrame:
    """Reads of two-base sequencing: colours and qualities by their name without the end's suffix; either may miss the other.

    Both: name, value. Qualities are numbers between spaces; negative ones count as 0.
    """
    trimmed = F.regexp_replace("name", r"_(F3|R3|F5(-P2)?|F5-BC|F5-DNA)$", "")
    q = F.array_join(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: F.char(F.least(F.greatest(x.cast("int"), F.lit(0)), F.lit(93)) + 33)), "")
    left = bases.select(trimmed.alias("name"), F.col("value").alias("seq"))
    right = qualities.select(trimmed.alias("name"), q.alias("qual"))
    return left.join(right, "name", "full_outer")


def natural_key(name: Column) -> Column:
    """A string that sorts names with numbers between underscores by those numbers."""
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "_")


def illumina_reads(rows: DataFrame, barcode: int = 0, second: bool = False) -> DataFrame:
    """rows: name, seq, qual with qualities from 64 on and '.' for N -> name, barcode, seq, qual (from 33 on). Second ends are turned round."""
    seq, qual = F.translate("seq", ".", "N"), F.col("qual")
    shifted = F.array_join(F.transform(F.split(qual, ""), lambda c: F.when(c == "", "").otherwise(F.char(F.greatest(F.ascii(c) - 31, F.lit(33))))), "")
    cut = F.substring(seq, F.lit(barcode + 1), F.length(seq))
    cut_q = F.substring(shifted, F.lit(barcode + 1), F.length(shifted))
    if second:
        cut, cut_q = reverse_complement(cut), F.reverse(cut_q)
    return rows.select("name", F.substring(seq, F.lit(1), F.lit(barcode)).alias("barcode"), cut.alias("seq"), cut_q.alias("qual"))


def barcode_length(reads: DataFrame, most: int = 10, share: float = 0.66) -> int:
    """The last place from ``most`` down to 2 at which over ``share`` of all reads have T, which ends a barcode; 0 if there is none."""
    places = [F.avg((F.upper(F.substring("seq", k, 1)) == "T").cast("int")).alias(str(k)) for k in range(2, most + 1)]
    row = reads.agg(*places).first()
    return next((k for k in range(most, 1, -1) if (row[str(k)] or 0) > share), 0)


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    """start_contig, start, end_contig, end of lines of four numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ["start_contig", "start", "end_contig", "end"]
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.element_at(parts, i + 1).cast("long").alias(n) for i, n in enumerate(names)])


def match_lines(cals: DataFrame, ends: DataFrame, offsets: bool = False) -> DataFrame:
    """Candidates as lines of text: name and number of ends, then for each end its read, quality, flag, and its places with their masks, or with their
    ``offsets`` between commas."""
    last = F.array_join(F.col("offsets").cast("array<string>"), ",") if offsets else F.col("mask")
    place = F.concat_ws("\t", F.col("contig").cast("string"), F.col("position").cast("string"), "strand", last)
    listed = cals.groupBy("read_id", "end_no").agg(F.sort_array(F.collect_list(F.struct("contig", "position", "strand", place.alias("t")))).alias("places"))
    end = F.concat_ws("\t", "seq", "qual", F.col("max_reached").cast("string"), F.coalesce(F.size("places"), F.lit(0)).cast("string"), F.array_join(F.transform(F.coalesce("places", F.array().cast("array<struct<contig: bigint, position: int, strand: string, t: string>>")), lambda p: p["t"]), "\t"))
    per_end = ends.join(listed, ["read_id", "end_no"], "left").select("read_id", "name", "end_no", end.alias("t"))
    whole = per_end.groupBy("read_id", "name").agg(F.sort_array(F.collect_list(F.struct("end_no", "t"))).alias("e"))
    return whole.select("read_id", F.concat_ws("\n", F.concat_ws("\t", "name", F.size("e").cast("string")), F.array_join(F.transform("e", lambda x: x["t"]), "\n")).alias("line"))


def _alternating(rows: DataFrame, least: int) -> DataFrame:
    """read_id, f (fields of the first line), ends (fields of each further one) of records that are a line of at least ``least`` fields and one for each end."""
    lines = F.split("line", "\n")
    return rows.select("read_id", F.split(lines[0], "\t").alias("f"), F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.split(x, "\t")).alias("ends")).where(F.size("f") >= least)


def read_match_lines(rows: DataFrame, offsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates, ends) of records (read_id, line) as ``match_lines`` makes them."""
    ends = _alternating(rows, 2).select("read_id", F.col("f")[0].alias("name"), F.posexplode("ends").alias("end_no", "e")).withColumn("end_no", F.col("end_no") + 1)
    state = ends.select("read_id", "name", "end_no", F.col("e")[0].alias("seq"), F.col("e")[1].alias("qual"), F.col("e")[2].cast("int").alias("max_reached"))
    n = F.col("e")[3].cast("int")
    place = lambda i, k: F.element_at("e", 5 + 4 * i + k)
    places = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        place(i, 0).cast("long").alias("contig"), place(i, 1).cast("int").alias("position"), place(i, 2).alias("strand"), place(i, 3).alias("mask"))))
    found = ends.select("read_id", "end_no", F.inline(places))
    if offsets:
        found = found.withColumn("offsets", F.split("mask", ",").cast("array<int>")).drop("mask")
    return found, state


def alignment_lines(alignments: DataFrame, ends: DataFrame) -> DataFrame:
    """Alignments as lines of text: name and number of ends, then for each end its read, quality, and its alignments: contig, position, strand, score,
    mapping quality, and the two aligned strings."""
    fields = ["contig", "position", "strand", "score", "mapq", "aln_read", "aln_ref"]
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in fields])
    listed = alignments.groupBy("read_id", "end_no").agg(F.sort_array(F.collect_list(F.struct("contig", "position", "strand", text.alias("t")))).alias("a"))
    joined = ends.join(listed, ["read_id", "end_no"], "left")
    lines = F.concat_ws("\t", "seq", "qual", F.greatest(F.coalesce(F.size("a"), F.lit(0)), F.lit(0)).cast("string"), F.array_join(F.transform("a", lambda p: p["t"]), "\t"))
    whole = joined.select("read_id", "name", "end_no", lines.alias("t")).groupBy("read_id", "name").agg(F.sort_array(F.collect_list(F.struct("end_no", "t"))).alias("e"))
    return whole.select("read_id", F.concat_ws("\n", F.concat_ws("\t", "name", F.size("e").cast("string")), F.array_join(F.transform("e", lambda x: x["t"]), "\n")).alias("line"))


def read_alignment_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alignments, ends) of records (read_id, line) as ``alignment_lines`` makes them."""
    ends = _alternating(rows, 2).select("read_id", F.col("f")[0].alias("name"), F.posexplode("ends").alias("end_no", "e")).withColumn("end_no", F.col("end_no") + 1)
    n = F.col("e")[2].cast("int")
    field = lambda i, k: F.element_at("e", 4 + 7 * i + k)
    kinds = [("contig", "long"), ("position", "long"), ("strand", "string"), ("score", "int"), ("mapq", "int"), ("aln_read", "string"), ("aln_ref", "string")]
    found = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[field(i, k).cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)])))
    return ends.select("read_id", "end_no", F.inline(found)), ends.select("read_id", "name", "end_no", F.col("e")[0].alias("seq"), F.col("e")[1].alias("qual"))


def offsets(text: str) -> list[int]:
    """Numbers between commas that rise from 0 or more."""
    found = [int(x) for x in text.split(",")]
    if any(a >= b for a, b in zip([-1, *found], found)):
        raise ValueError("offsets have to rise from 0")
    return found
