"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import exact_dedup, language, mixing, packing, simhash
from seedloom.llm.common import id_remainder, shielded, stored, table, unshielded
from seedloom.llm.queries import tokenizer_path

#: A document stays if its leading language has at least this proportion.
LEAST_PROPORTION = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or that no language leads, go."""
    model = language.fitted(docs.where(id_remainder(F.col("doc_id"), 4) != 2).select("lang", "text"))
    rows, names = shielded(docs, "text")
    # The text is needed twice: by the model, which keeps only its verdict, and in the result.
    found = language.predicted(rows.withColumn("_text", F.col("text")), model)
    stay = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_PROPORTION))
    return unshielded(stay, {c: "_text" if n == "text" else n for c, n in names.items()})


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the row with the smallest doc_id."""
    return simhash.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: a row for each piece of a document."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Neither the mixture model, nor fingerprints, nor subword ids can be told in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
