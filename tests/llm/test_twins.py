"""The registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(name, spark, sf_dir, engine):
    found = QUERIES[name].build(spark, sf_dir)
    result = engine.execute(QUERIES[name].sql)
    columns = sorted(item[0] for item in result.description)
    place = [[item[0] for item in result.description].index(c) for c in columns]
    assert sorted(found.columns) == columns
    want = sorted((tuple(row[i] for i in place) for row in result.fetchall()), key=str)
    assert sorted((tuple(row[c] for c in columns) for row in found.collect()), key=str) == want


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert [name.split("_")[0] for name in QUERIES] == [f"op{i}" for i in range(1, 14)]
