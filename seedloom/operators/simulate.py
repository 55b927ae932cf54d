"""Reads with known truth, and how well sets of seeds find reads with errors. All chance comes from hashes of ids."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import reverse_complement


def _chance(*parts: Column | str | int) -> Column:
    """A number from 0 up to 1 that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def simulated(reference: DataFrame, per_contig: int, read_length: int, snps: int = 0, deletion: int = 0, insertion: int = 0, seed: int = 0) -> DataFrame:
    """reference (contig, seq) -> read_id, name, contig, position, strand, snps, deletion, insertion, seq: ``per_contig`` reads of each contig that is long enough.

    A read is cut at a place by hash, changed at ``snps`` places, loses ``deletion`` bases in its middle or gains ``insertion``, and is turned round on half of all.
    """
    need = read_length + deletion
    cut = reference.where(F.length("seq") >= need).select("contig", "seq", F.explode(F.sequence(F.lit(0), F.lit(per_contig - 1))).alias("k"))
    cut = cut.withColumn("read_id", F.col("contig") * per_contig + F.col("k"))
    cut = cut.withColumn("position", (1 + F.floor(_chance(seed, "read_id", 1) * (F.length("seq") - need + 1))).cast("int"))
    half = read_length // 2
    left = F.substring("seq", F.col("position"), F.lit(half))
    right = F.substring("seq", F.col("position") + half + deletion, F.lit(read_length - half - insertion))
    gained = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(max(insertion, 1) - 1)), lambda i: F.substring(F.lit("acgt"), (F.pmod(F.xxhash64(F.lit(seed), "read_id", i), F.lit(4)) + 1).cast("int"), F.lit(1))), "")
    bases = F.concat(left, gained, right) if insertion else F.concat(left, right)
    for n in range(snps):
        at = (1 + F.floor(_chance(seed, "read_id", 10 + n) * read_length)).cast("int")
        old = F.substring(bases, at, F.lit(1))
        new = F.translate(old, "acgtACGT", "cgtaCGTA")
        bases = F.concat(F.substring(bases, F.lit(1), at - 1), new, F.substring(bases, at + 1, F.lit(read_length)))
    strand = F.when(_chance(seed, "read_id", 2) < 0.5, "-").otherwise("+")
    rows = cut.withColumn("strand", strand).withColumn("bases", bases)
    name = F.concat_ws("_", F.concat(F.lit("readNum="), F.col("read_id").cast("string")), F.concat(F.lit("strand="), "strand"), F.concat(F.lit("contig="), F.col("contig").cast("string")), F.concat(F.lit("pos="), F.col("position").cast("string")))
    return rows.select(
        "read_id", name.alias("name"), "contig", "position", "strand", F.lit(snps).alias("snps"), F.lit(deletion).alias("deletion"), F.lit(insertion).alias("insertion"), F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")).alias("seq")
    )


def truth_of(name: Column) -> list[Column]:
    """The truth that a simulated read's name holds: contig, position, strand."""
    field = lambda k, p: F.regexp_extract(name, f"{k}=({p})", 1)
    return [field("contig", r"\d+").cast("long").alias("contig"), field("pos", r"\d+").cast("int").alias("position"), field("strand", "[+-]").alias("strand")]


def seed_accuracy(spark: SparkSession, masks: list[str], read_length: int, errors: int, color: bool = False) -> DataFrame:
    """mask_set sizes from 1 to all, in order -> masks, profiles, found: of all reads with so many errors, those in which some window
    of the first ``masks`` masks avoids them. In colour space an error is two colours side by side."""
    profiles = [list(p) for p in combinations(range(read_length - (1 if color else 0)), errors)]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(profiles)], "profile int, wrong array<int>")
    wrong = F.array_union("wrong", F.transform("wrong", lambda e: e + 1)) if color else F.col("wrong")
    avoided = []
    for m in masks:
        ones = [i for i, c in enumerate(m) if c == "1"]
        windows = F.array(*[F.array(*[F.lit(o + i) for i in ones]) for o in range(read_length - len(m) + 1)])
        avoided.append(F.exists(windows, lambda w: ~F.arrays_overlap(w, wrong)) if read_length >= len(m) else F.lit(False))
    sums, any_yet = [], F.lit(False)
    for k, a in enumerate(avoided):
        any_yet = any_yet | a
        sums.append(F.struct(F.lit(k + 1).alias("masks"), F.count_if(any_yet).alias("found")))
    return table.agg(F.count(F.lit(1)).alias("profiles"), F.array(*sums).alias("s")).select("profiles", F.inline("s"))


def profile_accuracy(profiles: DataFrame, masks: Sequence[str]) -> DataFrame:
    """profiles (profile: 1 where a read is as the reference, else 0) -> masks, profiles, found: those in which some window fits one of the first ``masks`` masks."""
    sums, any_yet = [], F.lit(False)
    for k, m in enumerate(masks):
        any_yet = any_yet | F.col("profile").rlike(m.replace("0", "."))
        sums.append(F.struct(F.lit(k + 1).alias("masks"), F.count_if(any_yet).alias("found")))
    return profiles.agg(F.count(F.lit(1)).alias("profiles"), F.array(*sums).alias("s")).select("profiles", F.inline("s"))


def better_set(spark: SparkSession, candidates: list[str], size: int, read_length: int, errors: int) -> list[str]:
    """Masks chosen one by one, each the one that finds most reads with those before it; of equals the first."""
    chosen: list[str] = []
    while len(chosen) < size:
        rest = [c for c in candidates if c not in chosen]
        if not rest:
            break
        found = {c: seed_accuracy(spark, [*chosen, c], read_length, errors).agg(F.max("found")).first()[0] for c in rest}
        chosen.append(max(rest, key=lambda c: found[c]))
    return chosen


def _changed(windows: DataFrame, mask: str, kind: str) -> DataFrame:
    """windows (..., window): each with one change of a kind at each place that counts."""
    places = F.array(*[F.lit(i) for i, c in enumerate(mask) if c == "1"])
    bases = F.array(*[F.lit(b) for b in "acgt"])
    w, n = F.col("window"), len(mask)
    each = windows.withColumn("_p", F.explode(places))
    left, right = F.substring(w, F.lit(1), F.col("_p")), F.substring(w, F.col("_p") + 1, F.lit(n + 1))
    if kind == "insertion":  # the read has a base too many
        return each.withColumn("window", F.concat(left, F.substring(w, F.col("_p") + 2, F.lit(n + 1)))).drop("_p")
    each = each.withColumn("_b", F.explode(bases))
    rest = F.substring(right, 2, n + 1) if kind == "mismatch" else right
    return each.withColumn("window", F.substring(F.concat(left, F.col("_b"), rest), F.lit(1), F.lit(n))).drop("_p", "_b")


def gaps(mask: str) -> list[tuple[int, int]]:
    """Where each run of 0s between a mask's 1s begins, and how long it is."""
    return [(x.start(), len(x.group())) for x in re.finditer("0+", mask)]


def _in_gaps(windows: DataFrame, mask: str, insertions: int, deletions: int) -> list[DataFrame]:
    """Windows with bases of the read left out in one gap of the mask, or unknown ones added there: what lies behind the gap moves, and no base at a 1 is lost between."""
    w, n, found = F.col("window"), len(mask), []
    for at, size in gaps(mask):
        for k in range(1, min(size, insertions) + 1):
            found.append(windows.withColumn("window", F.concat(F.substring(w, F.lit(1), F.lit(at)), F.substring(w, F.lit(at + k + 1), F.lit(n - at)))))
        for k in range(1, min(size, deletions) + 1):
            found.append(windows.withColumn("window", F.concat(F.substring(w, F.lit(1), F.lit(at)), F.lit("n" * k), F.substring(w, F.lit(at + 1), F.lit(n - at - k)))))
    return found


def seed_variants(windows: DataFrame, mask: str, mismatches: int = 0, insertions: int = 0, deletions: int = 0, gap_insertions: int = 0, gap_deletions: int = 0) -> DataFrame:
    """windows (..., window: bases of a read from a seed's place on, one more for each insertion allowed) -> all that so many changes
    make of them, once each: up to ``mismatches`` bases changed at the mask's 1s, or up to so many bases of the read left out, or added; or, in one
    gap between the mask's 1s, up to so many left out, or added (``n`` stands for these), and no more than the gap has places."""
    cut = windows.withColumn("window", F.substring("window", 1, len(mask)))
    found = [cut]
    step = cut
    for _ in range(mismatches):
        step = _changed(step, mask, "mismatch").distinct()
        found.append(step)
    for kind, times in (("insertion", insertions), ("deletion", deletions)):
        step = windows
        for _ in range(times):
            step = _changed(step, mask, kind).distinct()
            found.append(step.withColumn("window", F.substring("window", 1, len(mask))))
    found += _in_gaps(windows, mask, gap_insertions, gap_deletions)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where(F.length("window") == len(mask)).distinct()


def random_mask(size: int, width: int, seed: int = 0) -> str:
    """A mask of ``width`` with ``size`` ones, its ends among them; the same for the same seed."""
    from random import Random

    if not 2 <= size <= width:
        raise ValueError("a mask has two ones or more, and no more than places")
    inner = Random(f"{seed} {size} {width}").sample(range(1, width - 1), size - 2)
    return "".join("1" if i in (0, width - 1) or i in inner else "0" for i in range(width))
