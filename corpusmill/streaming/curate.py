"""The per-document stages on a stream of files.

Acquisition, flagging, cleaning, anonymisation, trimming and the hash split
look at one row only, so the same functions run on a streaming DataFrame.
Deduplication against all earlier files and exact-share splits need the whole
table and stay batch; on files without copies the stream releases what
``curate`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill import schemas
from corpusmill.operators import flags
from corpusmill.plans.curate import routed


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schemas.CORPUS).options(**options).load(path)


def curate_rows(rows: DataFrame, min_lines: int = 30, seed: int = 42) -> DataFrame:
    """Split, anonymised, trimmed files; quarantined ones carry their reason."""
    done = routed(flags.filter_acquisition(rows), min_lines, seed)
    quarantine = F.when(F.col("route") == "quarantined", F.col("reason")).alias("quarantine")
    return done.filter(F.col("route").isin("kept", "quarantined")).select(*rows.columns, quarantine, "split")


def write_splits(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append released files to a table partitioned by split, exactly once."""
    released = rows.filter(F.col("quarantine").isNull()).drop("quarantine")
    writer = released.writeStream.format("parquet").partitionBy("split")
    return (
        writer.option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
