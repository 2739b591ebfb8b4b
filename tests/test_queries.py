"""Every registered query against its SQL over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows
from stackweave.plans.oracle import oracle
from stackweave.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ORACLE = oracle()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    mine = entry.queries()[name](spark, FOLDER).toArrow()
    theirs = database.execute(ORACLE[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
