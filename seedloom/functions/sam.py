"""Fields of SAM records."""

from __future__ import annotations

import math
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Bits of the FLAG field, and the score of a read without an alignment.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSED, MATE_REVERSED, FIRST, SECOND, SECONDARY = 1, 2, 4, 8, 16, 32, 64, 128, 256
NO_SCORE = -(1 << 31)
VERSION = "1.6"


def moved_left(read: str, ref: str) -> tuple[str, str]:
    """An alignment with each gap as far to the left as it goes without changing what is aligned."""
    rows = [list(read), list(ref)]
    at = 0
    while at < len(read):
        side = 0 if rows[0][at] == "-" else 1 if rows[1][at] == "-" else None
        if side is None:
            at += 1
            continue
        start, end = at, at
        while end + 1 < len(read) and rows[side][end + 1] == "-":
            end += 1
        after, gap, other = end + 1, rows[side], rows[1 - side]
        while start > 0 and gap[start - 1] != "-" and other[start - 1] != "-" and other[start - 1] == other[end]:
            start -= 1
            gap[end], gap[start] = gap[start], "-"
            end -= 1
        at = after
    return "".join(rows[0]), "".join(rows[1])


def cigar_of(read: str, ref: str) -> str:
    kinds = ("D" if a == "-" else "I" if b == "-" else "M" for a, b in zip(read, ref))
    return "".join(f"{sum(1 for _ in run)}{kind}" for kind, run in groupby(kinds))


def md_of(read: str, ref: str) -> tuple[str, int]:
    """The MD tag and the number of edits. Insertions don't show in MD; no zero stands before a leading deletion or after a last one."""
    out, run, edits, last = [], 0, 0, "begin"
    for a, b in zip(read.upper(), ref.upper()):
        if b == "-":
            edits += 1
        elif a == b and b not in ".N":
            run, last = run + 1, "match"
        else:
            edits += 1
            kind = "deletion" if a == "-" else "mismatch"
            if kind == "deletion" and last == "deletion" and not run:
                out.append(b)
            else:
                number = "" if kind == "deletion" and last == "begin" else str(run)
                out.append(number + ("^" if kind == "deletion" else "") + b)
            run, last = 0, kind
    if run or last in ("mismatch", "begin"):
        out.append(str(run))
    return "".join(out), edits


#: The least and the most quality of a base told from colours, and what two colours without an error add.
LEAST_QUALITY, MOST_QUALITY, BOTH_RIGHT = 1, 63, 10
TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def turned(text: str) -> str:
    return text.translate(TURN)[::-1]


def color_errors(read: str, ref: str, colors: str) -> str:
    """Along an alignment of bases, the colour read where it isn't the colour between its base and the one before, else '-'. ``colors`` begin with the adaptor's base.

    Inserted bases and deletions have none, whatever their colours are.
    """
    out, before, at = [], colors[:1].upper(), 1
    for a, b in zip(read.upper(), ref):
        if a == "-":
            out.append("-")
            continue
        known = before in "ACGT" and a in "ACGT"
        color = str("ACGT".index(before) ^ "ACGT".index(a)) if known else "4"
        seen = colors[at : at + 1].replace(".", "4")
        out.append("-" if b == "-" or color == seen else seen)
        before, at = a, at + 1
    return "".join(out)


def color_base_qualities(read: str, errors: str, qual: str, mode: int = 0) -> str:
    """Qualities of aligned bases from those of the colours on both sides of each.

    Mode 0: two right colours add up and 10 more, of one right and one wrong the difference counts, two wrong ones give the least; 1: the lesser; 2: the
    greater; 3: as 0 for two right ones, else the least. The last base has its only colour's. Held to 1 to 63.
    """
    q, out, at = [ord(c) - 33 for c in qual], [], 0
    for i, a in enumerate(read):
        if a == "-":
            continue
        if i == len(read) - 1 or at + 1 >= len(q):
            value = q[at] if at < len(q) else 0
        else:
            own, other, wrong, next_wrong = q[at], q[at + 1], errors[i] != "-", errors[i + 1] != "-"
            if mode in (1, 2):
                value = min(own, other) if mode == 1 else max(own, other)
            elif not wrong and not next_wrong:
                value = own + other + BOTH_RIGHT
            elif mode == 3 or (wrong and next_wrong):
                value = 0
            else:
                value = other - own if wrong else own - other
        out.append(chr(33 + min(max(value, LEAST_QUALITY), MOST_QUALITY)))
        at += 1
    return "".join(out)


def color_read_qualities(qual: str) -> str:
    """Qualities of the bases that an unplaced read's colours lead to: the first is its colour's, each other the mean chance of error of its colour and the one before; 0 if either is."""
    q, out = [ord(c) - 33 for c in qual], []
    for i, own in enumerate(q):
        value = own
        if i:
            before = q[i - 1]
            value = 0 if not own or not before else int(-10 * math.log10((10 ** (-own / 10) + 10 ** (-before / 10)) / 2) + 0.5)
        out.append(chr(33 + min(max(value, 0), MOST_QUALITY)))
    return "".join(out)


DESCRIBED = StructType([*[StructField(n, StringType()) for n in ("aln_read", "aln_ref", "cigar", "md")], StructField("edits", IntegerType()), StructField("errors", StringType()), StructField("bases", StringType()), StructField("qual", StringType())])


def described(read: Column, ref: Column, strand: Column | None = None, colors: Column | None = None, qual: Column | None = None, mode: int = 0) -> Column:
    """An alignment as SAM has it, along the forward strand: its gaps moved left, CIGAR, MD and number of edits; nulls for null.

    ``read`` and ``ref`` are in read direction. With ``colors`` (an adaptor's base and colours) and ``qual`` also the colour errors, bases and their qualities.
    """
    none = F.lit(None).cast("string")

    def told(reads: pd.Series, refs: pd.Series, strands: pd.Series, colored: pd.Series, quals: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, strand, c, q in zip(reads, refs, strands, colored, quals):
            if a is None or b is None:
                rows.append((None,) * 8)
                continue
            errors = bases = quality = None
            if c is not None:
                errors, bases = color_errors(a, b, c), a.replace("-", "").upper()
                quality = color_base_qualities(a, errors, q or "", mode)
            if strand == "-":
                a, b = turned(a), turned(b)
                errors, bases, quality = (errors[::-1], turned(bases), quality[::-1]) if c is not None else (None,) * 3
            a, b = moved_left(a, b)
            rows.append((a, b, cigar_of(a, b), *md_of(a, b), errors, bases, quality))
        return pd.DataFrame(rows, columns=DESCRIBED.names).astype({"edits": "Int32"})

    others = [none if x is None else x for x in (strand, colors, qual)]
    return F.pandas_udf(told, DESCRIBED)(read, ref, *others)


def flag(paired: Column, proper: Column, mapped: Column, mate_mapped: Column, reverse: Column, mate_reverse: Column, end_no: Column, secondary: Column) -> Column:
    """FLAG of a record; what concerns the mate counts for pairs only."""
    bit = lambda c, n: F.when(c, n).otherwise(0)
    mate = bit(proper, PROPER) + bit(~mate_mapped, MATE_UNMAPPED) + bit(mate_mapped & mate_reverse, MATE_REVERSED) + F.when(end_no == 1, FIRST).otherwise(SECOND)
    own = bit(~mapped, UNMAPPED) + bit(mapped & secondary, SECONDARY) + bit(mapped & reverse, REVERSED)
    return (F.when(paired, mate + PAIRED).otherwise(0) + own).cast("int")


def insert_length(position: Column, length: Column, mate_position: Column, mate_length: Column, together: Column) -> Column:
    """ISIZE: from the first base of the left end to the last of the other, negative for the right one; 0 unless both are on one contig."""
    left = mate_position + mate_length - position
    right = mate_position - position - length
    return F.when(together, F.when(mate_position < position, right).otherwise(left)).otherwise(0).cast("long")


def header_lines(reference: DataFrame, read_group: str | None = None, program: str = "seedloom", order: str = "unsorted") -> DataFrame:
    """n, line: @HD, an @SQ for each contig (contig, name, length), @RG and @PG, in order of n."""
    spark = reference.sparkSession
    sq = reference.select(F.col("contig").cast("long").alias("n"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("length").cast("string")).alias("line"))
    last = [(1 << 62, read_group)] if read_group else []
    rest = spark.createDataFrame([(-(1 << 62), f"@HD\tVN:{VERSION}\tSO:{order}"), *last, ((1 << 62) + 1, f"@PG\tID:{program}\tVN:1")], "n long, line string")
    return sq.unionByName(rest)


def read_group_tags(line: str) -> str:
    """The tags of records from an @RG line: RG, LB and PU, where it has ID, LB and PU."""
    fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
    if not line.startswith("@RG") or "ID" not in fields:
        raise ValueError("a read group is an @RG line with an ID")
    return "".join(f"\t{tag}:Z:{fields[name]}" for tag, name in (("RG", "ID"), ("LB", "LB"), ("PU", "PU")) if name in fields)


def base_quality(first: Column, second: Column, first_error: Column, second_error: Column, mode: int = 0) -> Column:
    """The quality of a base from those of the two colours beside it, held to 1 to 63; modes as in ``color_base_qualities``."""
    right = F.when(~first_error & ~second_error, first + second + BOTH_RIGHT)
    if mode == 0:
        value = right.when(first_error & second_error, F.lit(0)).when(first_error, second - first).otherwise(first - second)
    elif mode == 3:
        value = right.otherwise(F.lit(0))
    else:
        value = F.least(first, second) if mode == 1 else F.greatest(first, second)
    return F.least(F.greatest(value, F.lit(LEAST_QUALITY)), F.lit(MOST_QUALITY)).cast("int")


def records(
    alignments: DataFrame, ends: DataFrame, contigs: DataFrame, tags: str = "", space: str = "nt", quality: int = 0, algorithm: int | None = None, program: str = "seedloom"
) -> DataFrame:
    """SAM records. alignments: read_id, end_no, contig, position, strand, score, mapq, aln_read, aln_ref; ends: read_id, name, end_no, seq, qual; contigs: contig, name.

    ``proper``, where alignments have it, tells proper pairs. An end without an alignment has a record at its mate's place. The best alignment of an end is its first. Reads of over two ends give none.

    In colour space ``seq`` is an adaptor's base and colours, and ``qual`` the colours'. A placed read has the bases of its alignment, their qualities by ``quality``
    (see ``color_base_qualities``); an unplaced one those that its colours lead to. Tags CS, CQ and CM keep the colours, their qualities and the number of
    colour errors, XE where these are. ``algorithm``: how alignments were chosen, tag XA.

    Result: read_id, end_no, hit, contig and position (where the record stands; null without one), line.
    """
    color = space == "color"
    few = ends.withColumn("_ends", F.count(F.lit(1)).over(Window.partitionBy("read_id"))).where("_ends <= 2")
    order = Window.partitionBy("read_id", "end_no").orderBy(F.col("score").desc(), "contig", "position", "strand")
    a = alignments.join(contigs.select("contig", F.col("name").alias("_rname")), "contig").withColumn("_hit", F.row_number().over(order))
    a = a.withColumn("_hits", F.count(F.lit(1)).over(Window.partitionBy("read_id", "end_no"))).withColumn("_cc", F.lead("_rname").over(order)).withColumn("_cp", F.lead("position").over(order))
    own = (F.col("seq"), F.col("qual")) if color else (None, None)
    rows = few.join(a, ["read_id", "end_no"], "left").withColumn("_d", described(F.col("aln_read"), F.col("aln_ref"), F.col("strand"), *own, quality))
    mate = a.where("_hit = 1").select(
        "read_id", (3 - F.col("end_no")).alias("end_no"), F.col("_rname").alias("_mname"), F.col("contig").alias("_mcontig"), F.col("position").alias("_mpos"), F.col("strand").alias("_mstrand"), F.length("aln_read").alias("_mlen"), F.col("mapq").alias("_mq")
    )
    rows = rows.join(mate, ["read_id", "end_no"], "left")
    mapped, mated, paired = F.col("position").isNotNull(), F.col("_mpos").isNotNull(), F.col("_ends") == 2
    together = F.coalesce(mapped & mated & (F.col("contig") == F.col("_mcontig")), F.lit(False))
    absent = F.lit("*")
    tag = lambda name, kind, c: F.concat(F.lit(f"\t{name}:{kind}:"), c.cast("string"))
    where = lambda c, *parts: F.when(c, F.concat(*parts)).otherwise("")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    errors = F.coalesce(F.col("_d.errors"), F.lit(""))
    wrong = F.length(F.translate(errors, "-", ""))
    extra = F.concat(
        F.lit(f"{tags}\tPG:Z:{program}"), tag("AS", "i", F.coalesce("score", F.lit(NO_SCORE))), where(mated, tag("MQ", "i", F.col("_mq"))), where(mapped, tag("NM", "i", F.col("_d.edits"))),
        tag("NH", "i", one("_hits")), tag("IH", "i", one("_hits")), tag("HI", "i", one("_hit")), where(mapped, tag("MD", "Z", F.col("_d.md"))),
        F.concat(tag("CS", "Z", F.col("seq")), tag("CQ", "Z", F.col("qual")), tag("CM", "i", wrong)) if color else F.lit(""),
        where(F.col("_cc").isNotNull(), tag("CC", "Z", F.col("_cc")), tag("CP", "i", F.col("_cp"))),
        F.lit("" if algorithm is None else f"\tXA:i:{int(algorithm)}"), where(errors != "", tag("XE", "Z", errors)),
    )
    reverse = F.col("strand") == "-"
    from .bases import bases_of_colors, normalised_color_read, reverse_complement

    if color:
        unplaced = F.pandas_udf(lambda quals: quals.map(lambda q: None if q is None else color_read_qualities(q)), StringType())(F.when(~mapped, F.col("qual")))
        decoded = normalised_color_read(F.translate("seq", ".", "4"))
        seq = F.when(mapped, F.col("_d.bases")).otherwise(bases_of_colors(F.substring(decoded, F.lit(2), F.length(decoded))))
        qual = F.when(mapped, F.col("_d.qual")).otherwise(unplaced)
    else:
        seq, qual = (F.when(reverse, turn).otherwise(F.col(c)) for c, turn in (("seq", reverse_complement(F.col("seq"))), ("qual", F.reverse("qual"))))
    fields = [
        F.col("name"),
        flag(paired, together & F.coalesce(F.col("proper"), F.lit(False)) if "proper" in alignments.columns else F.lit(False), mapped, mated, F.coalesce(reverse, F.lit(False)), F.coalesce(F.col("_mstrand") == "-", F.lit(False)), F.col("end_no"), F.coalesce(F.col("_hit") > 1, F.lit(False))),
        F.coalesce("_rname", F.when(paired, F.col("_mname")), absent),
        F.coalesce("position", F.when(paired, F.col("_mpos")), F.lit(0)),
        F.coalesce("mapq", F.lit(0)),
        F.coalesce(F.col("_d.cigar"), absent),
        F.when(paired & mated, F.when(together, "=").otherwise(F.col("_mname"))).when(paired & mapped, "=").otherwise(absent),
        F.when(paired & mated, F.col("_mpos")).when(paired & mapped, F.col("position")).otherwise(0),
        insert_length(F.col("position"), F.length("aln_read"), F.col("_mpos"), F.col("_mlen"), F.coalesce(together, F.lit(False))),
        seq,
        qual,
    ]
    line = F.concat(F.concat_ws("\t", *[f.cast("string") for f in fields]), extra)
    stands = lambda c, m: F.coalesce(F.col(c), F.when(paired, F.col(m))).cast("long").alias(c)
    return rows.select("read_id", "end_no", F.coalesce("_hit", F.lit(0)).alias("hit"), stands("contig", "_mcontig"), stands("position", "_mpos"), line.alias("line"))


def write_sam(found: DataFrame, reference: DataFrame, path: str, read_group: str | None = None, program: str = "seedloom") -> None:
    """Records (``records``) with the header of reference (contig, name, length) as a folder whose parts, in the order of their names, are one SAM file sorted by place.

    The header's lines come first; then records are dealt by ranges of (contig, position), those without a place last, and sorted within: no task
    has more than its range. Records of one place stand in the order of reads, so that many at one place are dealt, too.
    """
    head = header_lines(reference, read_group, program, "coordinate").select(F.lit(0).alias("_kind"), F.col("n").alias("_a"), F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("read_id"), F.lit(0).alias("end_no"), F.lit(0).alias("hit"), "line")
    last = F.lit((1 << 63) - 1)
    body = found.select(F.lit(1).alias("_kind"), F.coalesce("contig", last).alias("_a"), F.coalesce("position", last).alias("_b"), "read_id", "end_no", "hit", "line")
    order = ["_kind", "_a", "_b", "read_id", "end_no", "hit"]
    head.unionByName(body).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
