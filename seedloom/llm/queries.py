"""The queries of this package: one per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, divergence, exact_dedup, importance, language, lz, mixing, packing, simhash, token_files, toxicity, url_filter, warc
from .common import id_remainder, table
from .sql import ORACLES

RULES = (
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.compared_in_order(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (id_remainder(F.col("doc_id"), 7) == 2).alias("held_out")
    return attention.scored(docs.select("doc_id", held_out, "text"), tokenizer_path("byte_bpe_50k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = language.fitted(docs.where(~held_out).select("lang", "text"))
    return language.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("languages")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fitted(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    return toxicity.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def page_outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages named by the document that their url's last number gives, and that document's label: bad if of low quality or toxic."""
    number = F.try_to_number(F.nullif(F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})[^/]*/?$", 1), F.lit("")), F.lit("9" * 18))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", number.cast("long").alias("item"))
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return pages, labels.select(F.col("doc_id").alias("item"), bad.alias("bad"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, outcomes = page_outcomes(spark, sf_dir)
    found = url_filter.judge(pages, outcomes, RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.resampled(docs, table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.digests(token_files.round_trip(docs, tokenizer_path("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lz_fingerprint": op1_lz_fingerprint,
    "op2_attention_lm": op2_attention_lm,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_importance": op11_importance,
    "op12_divergence": op12_divergence,
    "op13_token_files": op13_token_files,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
