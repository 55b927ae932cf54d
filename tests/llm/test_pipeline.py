"""Stages of the pipeline, and the queries that SQL can express."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from seedloom.llm import language, queries, simhash
from seedloom.llm.sql import ORACLES

DATA = Path("/root/testdata/sf0.001")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(rel.columns) == sorted(got.columns)
    want = sorted(rel.fetchall(), key=str)
    assert sorted([tuple(r) for r in got.select(*rel.columns).collect()], key=str) == want


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert sizes[0] == sizes[1] > sizes[2] >= sizes[3]
    exact = spark.read.parquet(str(tmp_path / "exact_dedup"))
    assert exact.select("text").distinct().count() == exact.count()
    near = spark.read.parquet(str(tmp_path / "simhash_near_dedup"))
    assert simhash.near_duplicates(near.select("doc_id", "text")).select("root").distinct().count() == near.count()
    assert corpus_pipeline.run(spark, str(DATA)).count() == sizes[-1]


def test_language_stage_drops_what_has_no_letters(spark):
    rows = [(1, "the thing and the other", "en", "s", 1), (2, "12 !", "en", "s", 1), (3, None, None, None, None), (5, "the and thing", "en", "s", 2)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 5]
    assert language.UNKNOWN == "und"


def test_stages_take_nothing(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


