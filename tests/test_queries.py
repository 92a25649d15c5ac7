"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from corpusmill.queries import ALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    yield connection
    connection.close()


def in_order(columns, rows):
    place = [columns.index(name) for name in sorted(columns)]
    return sorted((tuple(row[i] for i in place) for row in rows), key=str)


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.sql])
def test_query_equals_sql(name, spark, sf_dir, engine):
    found = ALL[name].build(spark, sf_dir)
    result = engine.execute(ALL[name].sql)
    columns = [item[0] for item in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert in_order(found.columns, found.collect()) == in_order(columns, result.fetchall())


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if not q.sql])
def test_query_without_sql_runs(name, spark, sf_dir):
    assert ALL[name].build(spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 7
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
