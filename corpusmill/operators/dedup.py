"""Exact deduplication. Reports move hashes and ids; only bodies that may have a copy are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

#: Bits of the bitmap of repeated hashes: one bucket at least, 64 MB at most.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 29


def copy_groups(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per distinct content, null content included as its own group.

    Only key, size and hash are grouped; partial aggregation absorbs a group
    that holds a large share of the rows.
    """
    hashed = df.select(key, "size", F.sha2("content", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum("size").alias("bytes_all"),
        F.min(F.struct(key, "size")).alias("first"),
    )


def repeated_bits(hashes: DataFrame, name: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """A bitmap of the values of ``name`` that occur twice or more, as rows (bucket, bitmap), and its size.

    Values share bits, so a bit says "perhaps". The size follows the number of
    repeated values, which is counted here, and never exceeds ``most_bits``
    (64 MB), so the bitmap can be broadcast whatever the table; a fuller one
    only means more suspects.
    """
    repeated = hashes.groupBy(name).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    repeated = cut_lineage(repeated.select(name))
    bits = min(most_bits, max(LEAST_BITS, 1 << (32 * repeated.count()).bit_length()))
    place = F.pmod(F.col(name), F.lit(bits))
    maps = repeated.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )
    return maps, bits


def _bit_is_set(bitmap: Column, place: Column) -> Column:
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def suspects(df: DataFrame, column: str = "content", most_bits: int = MOST_BITS) -> DataFrame:
    """Add ``suspect``: whether another row may hold the same content. No row moves.

    Only 8-byte hashes are shuffled. Every row with a copy is a suspect; a row
    without one is, where its hash shares a bit with a repeated one.
    """
    hashed = df.withColumn("content_code", F.xxhash64(column))
    maps, bits = repeated_bits(hashed.filter(F.col(column).isNotNull()).select("content_code"), "content_code", most_bits)
    place = F.pmod("content_code", F.lit(bits))
    marked = hashed.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "bucket", "left")
    return marked.withColumn("suspect", _bit_is_set(F.col("bitmap"), place)).drop("bucket", "bitmap", "content_code")


def deduplicate(df: DataFrame, key: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """Keep one row of each distinct content: that with the lowest key, and no null content.

    Keys may repeat and may be null (null comes last); of rows with equal keys
    and contents, the one whose other columns are lowest stays. Rows that
    cannot have a copy stay where they are. Suspects are aggregated to one row
    per content before they are shuffled, so a group of copies of any size is
    one row per task.
    """
    marked = suspects(df, most_bits=most_bits)
    alone = marked.filter("content IS NOT NULL AND NOT suspect").select(*df.columns)
    others = [c for c in df.columns if c not in (key, "content")]
    ordered = F.struct(F.col(key).isNull().alias("last"), key, *others, "content")
    first = (
        marked.filter("content IS NOT NULL AND suspect")
        .groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min(ordered).alias("first"))
    )
    return alone.unionByName(first.select(*(F.col("first")[c].alias(c) for c in df.columns)))


def reduction_report(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows and bytes before and after, from one aggregation over hashes."""
    valid = F.col("content_hash").isNotNull()
    totals = copy_groups(df, key).agg(
        F.sum("copies").alias("rows_read"),
        F.coalesce(F.sum(F.when(~valid, F.col("copies"))), F.lit(0)).alias("null_rows"),
        F.count("content_hash").alias("rows_after"),
        F.sum("bytes_all").alias("bytes_before"),
        F.sum(F.when(valid, F.col("first.size"))).alias("bytes_after"),
    )
    return totals.select(
        "rows_read", "null_rows", "rows_after",
        F.round(100 * (1 - F.col("rows_after") / F.col("rows_read")), 6).alias("row_cut_pct"),
        "bytes_before", "bytes_after",
        F.round(
            100 * (F.col("bytes_before") - F.col("bytes_after")) / F.col("bytes_before"), 6
        ).alias("size_cut_pct"),
    )


def duplicate_clusters(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Size of every group of copies."""
    groups = copy_groups(df, key).filter("content_hash IS NOT NULL AND copies > 1")
    return groups.select("content_hash", F.col(f"first.{key}").alias("first_id"), "copies")
