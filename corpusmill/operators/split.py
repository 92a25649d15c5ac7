"""Samples, subsets, splits and training shards, all from seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import global_rank, seeded_hash


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Shuffle and take ``n``: a distributed top-n over the hash."""
    return df.orderBy(seeded_hash(seed, F.col(key)), key).limit(n)


def first_rows(df: DataFrame, n: int = 500, key: str = "doc_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def hash_bucket(key: Column, seed: int = 42, buckets: int = 1000) -> Column:
    lead = F.substring(seeded_hash(seed, key), 1, 8)
    return F.conv(lead, 16, 10).cast("bigint") % buckets


def assign_split(
    df: DataFrame, test: float = 0.1, validation: float = 0.1, seed: int = 42,
    key: str = "doc_id",
) -> DataFrame:
    """Per-row split: no shuffle, and appended rows never move the old ones."""
    bucket = hash_bucket(F.col(key), seed)
    limit = round(test * 1000)
    split = (
        F.when(bucket < limit, "test")
        .when(bucket < limit + round(validation * 1000), "validation")
        .otherwise("train")
    )
    return df.withColumn("split", split)


def assign_split_exact(
    df: DataFrame, test: float = 0.1, validation: float = 0.1, seed: int = 42,
    key: str = "doc_id",
) -> DataFrame:
    """Exact shares: ``ceil`` of the test share, then of the rest's share.

    Only hashes of keys are ranked, one per row; a split is a range of hashes,
    so each row finds its own by the two borders and nothing is joined back.
    Rows of a repeated key, or of null keys, have one hash and stay together:
    shares are exact but for copies of the keys at the borders.
    """
    order = seeded_hash(seed, F.col(key))
    ranked = global_rank(df.select(key, order.alias("order_hash")), "order_hash", key)
    n_test = F.ceil(F.round(F.col("n_total") * test, 6))
    rest = F.col("n_total") - n_test
    n_validation = F.ceil(F.round(rest * (validation / (1 - test)), 6))
    last = lambda upto: F.coalesce(F.max(F.when(F.col("rank") <= upto, F.col("order_hash"))), F.lit(""))
    borders = ranked.agg(
        F.struct(last(n_test).alias("test"), last(n_test + n_validation).alias("validation")).alias("borders")
    ).scalar()
    split = (
        F.when(order <= borders["test"], "test")
        .when(order <= borders["validation"], "validation")
        .otherwise("train")
    )
    return df.withColumn("split", split)


def in_epoch_order(
    df: DataFrame, epoch: int, batch_size: int, shards: int = 8, seed: int = 42,
    key: str = "doc_id",
) -> DataFrame:
    """The rows with their place in a reproducible epoch order: ``batch_no``, ``slot`` and ``shard``.

    Rows are ranked, not keys: each has a place of its own, also those of
    repeated or null keys, which follow each other by all their columns. Null
    keys are spread by their columns as well.
    """
    columns = F.xxhash64(*df.columns)
    spread = F.when(F.col(key).isNull(), columns)
    hashed = df.withColumn("order_hash", seeded_hash(f"{seed}:{epoch}", F.col(key), spread)).withColumn("order_row", columns)
    ranked = global_rank(hashed, "order_hash", key, "order_row")
    place = F.col("rank") - 1
    batch = F.floor(place / batch_size).cast("bigint")
    return ranked.select(
        *df.columns, batch.alias("batch_no"), (place % batch_size).cast("bigint").alias("slot"),
        (batch % shards).cast("bigint").alias("shard"),
    )


def epoch_batches(
    df: DataFrame, epoch: int, batch_size: int, shards: int = 8, seed: int = 42,
    key: str = "doc_id",
) -> DataFrame:
    """The places of ``in_epoch_order`` for the keys alone, one row per row of ``df``."""
    return in_epoch_order(df.select(key), epoch, batch_size, shards, seed, key)
