from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def texts(spark):
    """Apply a column function to texts and return the results in order."""
    from pyspark.sql import functions as F

    def run(function, items):
        rows = spark.createDataFrame(list(enumerate(items)), "i int, t string").coalesce(1)
        out = rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()
        return [row["v"] for row in out]

    return run


@pytest.fixture(scope="session")
def corpus_of(spark):
    """A small corpus from ``{path: content}`` or ``[(repo, path, content)]``."""
    from corpusmill.schemas import CORPUS

    def make(files):
        if isinstance(files, dict):
            files = [("repo", path, content) for path, content in files.items()]
        rows = [
            (i, repo, path, len(content or ""), content, "mit")
            for i, (repo, path, content) in enumerate(files)
        ]
        return spark.createDataFrame(rows, CORPUS)

    return make
