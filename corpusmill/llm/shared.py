"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage: a lost executor costs the tasks of one step,
and what it had finished is read back from the shared folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own that
    goes with the process; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="corpusmill-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of that folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, as a table written once and read from then on."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
