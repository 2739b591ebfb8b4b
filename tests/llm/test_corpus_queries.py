"""The registered queries against their SQL over the smallest tables, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from check import rows
from stackweave.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    database = duckdb.connect()
    for file in os.listdir(FOLDER):
        database.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    mine = QUERIES[name](spark, FOLDER).toArrow()
    theirs = database.execute(ORACLE[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert rows(mine) == rows(theirs)


def test_pipeline(spark):
    docs = corpus_pipeline.read(spark, FOLDER, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER))
        kept.append(docs.count())
        assert docs.columns == (columns if name != "token_files" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert kept[0] > kept[1] > kept[2] >= kept[3] > 0 and kept[4] == kept[5] > 0


def test_pipeline_of_nothing(spark):
    docs = corpus_pipeline.read(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER))
    assert docs.count() == 0
