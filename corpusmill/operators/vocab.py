"""Vocabularies: word counts, alphabets, ids, trimming and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.tokens import pre_tokens


def pre_token_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode(pre_tokens(F.col("content"))).alias("pos", "word"))


def pre_token_counts(df: DataFrame) -> DataFrame:
    """The trainer's input: distinct pre-tokens with their frequency."""
    words = df.select(F.explode(pre_tokens(F.col("content"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def alphabet(word_counts: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Characters by weighted frequency; ties go to the lower code point."""
    chars = word_counts.select(F.explode(F.split("word", "")).alias("char"), "freq")
    counted = chars.filter("char <> ''").groupBy("char").agg(F.sum("freq").alias("n"))
    return counted.orderBy(F.desc("n"), "char").limit(limit) if limit else counted


def pair_counts(word_counts: DataFrame, min_frequency: int = 2) -> DataFrame:
    """Adjacent character pairs weighted by word frequency: one BPE count."""
    symbols = F.split("word", "")
    pairs = F.transform(
        F.sequence(F.lit(1), F.length("word") - 1),
        lambda i: F.struct(
            F.get(symbols, i - 1).alias("left"), F.get(symbols, i).alias("right")
        ),
    )
    rows = word_counts.filter(F.length("word") > 1).select(F.inline(pairs), "freq")
    counted = rows.groupBy("left", "right").agg(F.sum("freq").alias("n"))
    return counted.filter(F.col("n") >= min_frequency)


def word_vocabulary(word_counts: DataFrame, specials, size: int) -> DataFrame:
    """Word-level ids: specials first, then words by frequency.

    The limit bounds the rows before the id window, which runs in one place.
    """
    spark = word_counts.sparkSession
    head = spark.createDataFrame(
        [(token, i) for i, token in enumerate(specials)], "token string, id int"
    )
    top = word_counts.orderBy(F.desc("freq"), "word").limit(size - len(specials))
    number = F.row_number().over(Window.orderBy(F.desc("freq"), "word")) - 1 + len(specials)
    tail = top.select(F.col("word").alias("token"), number.alias("id"))
    return head.unionByName(tail)


def trimmed_coverage(word_counts: DataFrame, sizes) -> DataFrame:
    """Share of occurrences that the ``k`` most frequent words cover, per k."""
    top = word_counts.orderBy(F.desc("freq"), "word").limit(max(sizes))
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), "word"))
    totals = word_counts.agg(F.sum("freq").alias("total"), F.count(F.lit(1)).alias("n_words"))
    kept = top.withColumn("rank", rank).agg(
        *(F.sum(F.when(F.col("rank") <= k, F.col("freq"))).alias(f"c_{k}") for k in sizes)
    )
    both = kept.withColumns(
        {name: totals.select(name).scalar() for name in ("total", "n_words")}
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(k).cast("bigint").alias("vocab_size"), F.col(f"c_{k}").alias("covered"),
                F.col("n_words"),
                F.round(F.col(f"c_{k}") / F.col("total"), 6).alias("coverage"),
            )
            for k in sizes
        )
    )
    return both.select(F.inline(rows))


def token_ids(tokens: DataFrame, vocab: DataFrame, unknown_id: int | None = None) -> DataFrame:
    """Add ``id`` to a table with ``token``; unknown tokens get ``unknown_id``.

    How the vocabulary is joined is left to Spark, by its measured size.
    """
    joined = tokens.join(vocab, "token", "left")
    if unknown_id is None:
        return joined
    return joined.withColumn("id", F.coalesce("id", F.lit(unknown_id)))


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(
        F.count(F.lit(1)).alias("size"), F.min("id").cast("bigint").alias("min_id"),
        F.max("id").cast("bigint").alias("max_id"),
    )


def longest_in_batch(df: DataFrame, batch: Column, column: str = "input_ids") -> DataFrame:
    """Add the longest sequence length of the row's batch (batches are small)."""
    return df.withColumn("batch_id", batch).withColumn(
        "batch_longest", F.max(F.size(column)).over(Window.partitionBy("batch_id"))
    )
