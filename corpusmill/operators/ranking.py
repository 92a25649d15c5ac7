"""Exact ranks and running values without one big window partition.

Ranks and running maxima over a whole table (or over one hot key) are built in
two levels: a window inside small blocks, and a window over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(seed, *keys: Column) -> Column:
    """SHA-256 of ``seed:key...``: a reproducible random order."""
    parts = [F.lit(str(seed))] + [key.cast("string") for key in keys]
    return F.sha2(F.concat_ws(":", *parts), 256)


def global_rank(df: DataFrame, order: str, *ties: str, digits: int = 4) -> DataFrame:
    """Add ``rank`` (from 1) and ``n_total`` for a hexadecimal hash column.

    The hash prefix splits the rows into at most 16^digits even blocks; only
    the block counts are accumulated in one place, so they may be broadcast.
    """
    df = df.withColumn("hash_block", F.substring(order, 1, digits))
    counts = df.groupBy("hash_block").agg(F.count(F.lit(1)).alias("block_rows"))
    before = Window.orderBy("hash_block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "hash_block",
        F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("block_offset"),
        F.sum("block_rows").over(everything).alias("n_total"),
    )
    inside = Window.partitionBy("hash_block").orderBy(order, *ties)
    return (
        df.join(F.broadcast(offsets), "hash_block")
        .withColumn("rank", F.row_number().over(inside) + F.col("block_offset"))
        .drop("hash_block", "block_offset")
    )


def rank_within(df: DataFrame, key: str, block: Column, *order: str) -> DataFrame:
    """Add ``rank`` (from 1) per ``key``; ``block`` must rise with ``order``.

    A hot key is ranked block by block, so no task sorts all of its rows.
    """
    df = df.withColumn("rank_block", block)
    counts = df.groupBy(key, "rank_block").agg(F.count(F.lit(1)).alias("block_rows"))
    before = (
        Window.partitionBy(key).orderBy("rank_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        key, "rank_block",
        F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("block_offset"),
    )
    inside = Window.partitionBy(key, "rank_block").orderBy(*order)
    return (
        _with_block(df, offsets, key, "rank_block", "block_offset")
        .withColumn("rank", F.row_number().over(inside) + F.col("block_offset"))
        .drop("rank_block", "block_offset")
    )


def _with_block(df: DataFrame, blocks: DataFrame, key: str, block: str, value: str) -> DataFrame:
    """Add the value of each row's block; a null key or block is one like others."""
    same = df[key].eqNullSafe(F.col("__key")) & df[block].eqNullSafe(F.col("__block"))
    renamed = blocks.select(F.col(key).alias("__key"), F.col(block).alias("__block"), value)
    return df.join(renamed, same).drop("__key", "__block")


def running_max(
    df: DataFrame, key: str, position: str, value: str, name: str,
    include_current: bool = False, block_rows: int = 4096,
) -> DataFrame:
    """Add the running maximum of ``value`` per ``key`` in ``position`` order."""
    df = df.withColumn("max_block", F.floor(F.col(position) / block_rows))
    maxima = df.groupBy(key, "max_block").agg(F.max(value).alias("block_max"))
    before = Window.partitionBy(key).orderBy("max_block").rowsBetween(Window.unboundedPreceding, -1)
    maxima = maxima.select(key, "max_block", F.max("block_max").over(before).alias("earlier_max"))
    last = Window.currentRow if include_current else -1
    inside = (
        Window.partitionBy(key, "max_block").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    return (
        _with_block(df, maxima, key, "max_block", "earlier_max")
        .withColumn(name, F.greatest(F.max(value).over(inside), F.col("earlier_max")))
        .drop("max_block", "earlier_max")
    )


def with_group_rows(df: DataFrame, key: str, position: str, name: str, block_rows: int = 4096) -> DataFrame:
    """Add how many rows each ``key`` has. A hot key comes in blocks of positions, which are joined one by one."""
    df = df.withColumn("size_block", F.floor(F.col(position) / block_rows))
    blocks = df.groupBy(key, "size_block").agg(F.count(F.lit(1)).alias("block_rows"))
    blocks = blocks.select(key, "size_block", F.sum("block_rows").over(Window.partitionBy(key)).alias(name))
    return _with_block(df, blocks, key, "size_block", name).drop("size_block")
