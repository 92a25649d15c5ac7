"""Corpus tables in and out: scans, split tables, audit and metric sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import schemas
from corpusmill.operators.split import in_epoch_order

#: Most rows of an exported file; rows of a task that writes several files, about.
ROWS_PER_FILE, ROWS_PER_TASK = 1 << 17, 1 << 14
SPLITS = ("train", "test", "validation")


def read_corpus(
    spark: SparkSession, path: str, fmt: str = "parquet",
    schema: T.StructType = schemas.CORPUS, **options,
) -> DataFrame:
    """Scan a corpus in any Spark file format with a declared schema."""
    if fmt == "csv":
        options = {"header": True, "multiLine": True, "escape": '"'} | options
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


SPREAD = "corpusmill.spread.partitions"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key into as many partitions as the session setting SPREAD says.

    For tables written as one huge row group, which scan in one task. Without
    the setting nothing moves.
    """
    partitions = rows.sparkSession.conf.get(SPREAD, None)
    return rows.repartition(int(partitions), key) if partitions else rows


def read_split(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Named splits of a table partitioned by split; others are not listed."""
    table = spark.read.schema(schemas.ANONYMIZED).parquet(path)
    return table.filter(F.col("split").isin(*splits))


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Concatenate split tables and remember where each row came from."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One stage's output, a folder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_audit_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV that survives multi-line content; arrays become readable text."""
    flat = [
        F.array_join(f.name, "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else f.name
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)


def read_audit_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_corpus(spark, path, "csv", schema)


def write_metrics_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_vocab(vocab: DataFrame, merges: DataFrame | None, path: str) -> None:
    """Token ids and ranked merges, as two tables under one folder."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if merges is not None:
        merges.write.mode("overwrite").parquet(f"{path}/merges")


def write_vocab_json(vocab: DataFrame, path: str) -> None:
    """The vocabulary as one JSON object from token to id; it is as large as its tokenizer was configured."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id"))))
    vocab.agg(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    ids = F.from_json("value", T.MapType(T.StringType(), T.IntegerType()))
    return text.select(F.explode(ids).alias("token", "id"))


def write_token_counts(encoded: DataFrame, path: str, key: str = "doc_id") -> None:
    """How many tokens each document has, as CSV with a header."""
    write_audit_csv(encoded.select(key, F.size("input_ids").alias("n_tokens")), path)


def write_shards(
    inputs: DataFrame, path: str, epoch: int, batch_size: int, shards: int = 8, seed: int = 42,
    rows_per_file: int = ROWS_PER_FILE, tokens: str = "input_ids", key: str = "doc_id",
) -> DataFrame:
    """Model inputs in the order of an epoch as ``data/shard=../file=..``, and their manifest.

    A file holds whole batches in order, ``rows_per_file`` rows at most (one
    batch, if that is larger), and is written by one task; so a shard of any
    size is as many files as it needs. A task writes one file after the other
    where files are small, since the driver hears of every task. Each row gets its place by itself and
    is in exactly one file, also where keys repeat or are null. The manifest
    has a row per file: first and last batch, rows, tokens; it is read from
    what was written. Without rows there is no file and no row.
    """
    spark = inputs.sparkSession
    per_file = max(1, rows_per_file // batch_size)  # batches
    rows = inputs.count()
    batches = -(-rows // batch_size)
    files = max(1, -(-(-(-batches // shards)) // per_file))  # of a shard
    placed = in_epoch_order(inputs, epoch, batch_size, shards, seed, key)
    placed = placed.withColumn("file", F.floor(F.floor(F.col("batch_no") / shards) / per_file).cast("bigint"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(shards * files, max(usual, -(-rows // ROWS_PER_TASK)))
    task = ((F.col("shard") * files + F.col("file")) % tasks).cast("int")
    ordered = placed.repartitionById(tasks, task).sortWithinPartitions("shard", "file", "batch_no", "slot")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("shard", "file").parquet(f"{path}/data")
    manifest = (
        spark.read.schema(T.StructType([*ordered.schema.fields])).parquet(f"{path}/data")
        .groupBy("shard", "file").agg(
            F.min("batch_no").alias("first_batch"), F.max("batch_no").alias("last_batch"),
            F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("bigint").alias("n_tokens"),
        )
    )
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard of an export; only its folders are listed. Sort by batch_no and slot for the order."""
    return spark.read.parquet(f"{path}/data").filter(F.col("shard") == shard)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VOCAB).parquet(f"{path}/vocab")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MERGES).parquet(f"{path}/merges")
