"""Helpers shared by the training-text operators."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, stored

__all__ = ["scratch", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def word_count(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(c: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_of(text: bytes) -> int:
    return zlib.crc32(text)


def as_scan(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` itself if it is a plain file scan, else a copy of it in the shared folder."""
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018  the analyser decides
    except AnalysisException:
        return stored(docs, label)
    return docs


def located(docs: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``_file`` and ``_row``, which tell rows apart even if all their columns are equal.

    A plain file scan knows them already; anything else is written to the shared
    folder first, so that a row keeps its place however often it is read.
    """
    kept = [F.col(f"`{c}`") for c in (columns or docs.columns)]
    return as_scan(docs, label).select(
        *kept, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )


def apart(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` without the columns that an operator gives itself: its own take their place."""
    return docs.drop(*[c for c in docs.columns if c.lower() in own])


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``used`` under names that can't clash with an operator's own, and the names to give back."""
    names = {c: c if c in used else f"_kept{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def unshielded(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def without(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of a plain file scan that are at none of ``places`` (_file, _row), with their own columns."""
    where = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    names = {c: f"_kept{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *where)
    return unshielded(rows.join(places, ["_file", "_row"], "left_anti"), names)
