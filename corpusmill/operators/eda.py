"""Counts and reports over a corpus. One scan per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import text as X

WORD_GAP = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
GIB = 2**30


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("size").cast("bigint").alias("n_bytes"),
        F.round(F.sum("size") / GIB, 6).alias("gib"),
    )


def reduction(before_rows: Column, after_rows: Column, before: Column, after: Column) -> list[Column]:
    """Row cut rounded up to whole percent, size cut to two places."""
    return [
        F.ceil((before_rows - after_rows) / before_rows * 100).cast("bigint").alias("row_cut_pct"),
        F.round((before - after) / before * 100, 2).alias("size_cut_pct"),
    ]


def reduction_of_kept(df: DataFrame, kept: Column) -> DataFrame:
    """Row and size reduction of a filter, with the filter as a column."""
    sums = df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"),
        F.sum("size").cast("bigint").alias("bytes_before"),
        F.sum(F.when(kept, F.col("size")).otherwise(0)).cast("bigint").alias("bytes_after"),
    )
    names = ("rows_before", "rows_after", "bytes_before", "bytes_after")
    return sums.select(*names, *reduction(*(F.col(name) for name in names)))


def reason_counts(flagged: DataFrame, reasons) -> DataFrame:
    """Every reason with its count and share, zero counts included."""
    sums = flagged.agg(
        F.count(F.lit(1)).alias("n_total"),
        *(
            F.count_if(F.coalesce(F.col("reason_code") == r, F.lit(False))).alias(f"n_{r}")
            for r in reasons
        ),
        F.count_if(F.col("remove_flag") & F.col("reason_code").isNull()).alias("n_NO_REASON"),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(r).alias("reason_code"), F.col(f"n_{r}").alias("n_rows"),
                F.round(F.col(f"n_{r}") / F.col("n_total") * 100, 2).alias("pct_of_all"),
            )
            for r in (*reasons, "NO_REASON")
        )
    )
    return sums.select(F.inline(rows))


def splits_report(df: DataFrame, removed: Column) -> DataFrame:
    """Rows and removed rows per split, with the total as split ``all``."""
    sums = df.rollup("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(removed).alias("n_removed")
    )
    return sums.select(
        F.coalesce("split", F.lit("all")).alias("split"), "n_rows", "n_removed",
        (F.col("n_rows") - F.col("n_removed")).alias("n_left"),
        F.round(F.col("n_removed") / F.col("n_rows") * 100, 6).alias("removed_pct"),
    )


# --- placeholder variables ------------------------------------------------


def variable_frequencies(df: DataFrame, pattern: str = R.VARIABLE_REGEX, splits=("train",)) -> DataFrame:
    """``(var, n, first_seen)``; partial aggregation handles a hot variable."""
    if splits:
        df = df.filter(F.col("split").isin(*splits))
    found = df.select("doc_id", F.posexplode(X.find_all(F.col("content"), pattern)).alias("pos", "var"))
    return found.groupBy("var").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first_seen")
    )


def variable_totals(frequencies: DataFrame) -> DataFrame:
    return frequencies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count(F.lit(1)).alias("n_distinct")
    )


def rare(frequencies: DataFrame, below: int = 100) -> DataFrame:
    return frequencies.filter(F.col("n") < below)


def frequency_extremes(
    frequencies: DataFrame, top: int = 10, bottom: int = 100, last_rare: int = 10,
    below: int = 100,
) -> DataFrame:
    """Most and least frequent items and the rare items seen last."""
    most = frequencies.orderBy(F.desc("n"), "var").limit(top)
    least = frequencies.orderBy("n", F.desc("var")).limit(bottom)
    late = rare(frequencies, below).orderBy(F.desc("first_seen")).limit(last_rare)
    parts = [
        part.select(F.lit(name).alias("list"), "var", "n")
        for name, part in (("most", most), ("least", least), ("last_rare", late))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def band_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("band").agg(F.count(F.lit(1)).alias("n_rows"))


# --- words ----------------------------------------------------------------


def whitespace_words(text: Column) -> Column:
    """Words as a plain whitespace split gives them, never an empty one."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def word_frequencies(df: DataFrame) -> DataFrame:
    words = df.select(F.explode(whitespace_words(F.col("content"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_totals(frequencies: DataFrame) -> DataFrame:
    return frequencies.agg(
        F.count(F.lit(1)).alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words")
    )


def token_count_stats(counts: DataFrame, column: str = "n_tokens") -> DataFrame:
    """Mean and exact median. Equal counts collapse before the percentile."""
    histogram = counts.groupBy(column).agg(F.count(F.lit(1)).alias("n_docs"))
    return histogram.agg(
        F.sum("n_docs").alias("n_docs"),
        F.round(F.sum(F.col(column) * F.col("n_docs")) / F.sum("n_docs"), 6).alias(
            "mean_token_count"
        ),
        F.percentile(column, 0.5, F.col("n_docs")).alias("median_token_count"),
    )


def token_count_histogram(counts: DataFrame, column: str = "n_tokens") -> DataFrame:
    return counts.groupBy(column).agg(F.count(F.lit(1)).alias("n_docs"))


def distinct_words_by_stage(stages: dict[str, DataFrame]) -> DataFrame:
    """Distinct words per stage; words are reduced per stage before counting."""
    parts = [
        df.select(F.lit(name).alias("stage"), F.explode(F.array_distinct(
            whitespace_words(F.col("content")))).alias("word"))
        for name, df in stages.items()
    ]
    words = parts[0]
    for part in parts[1:]:
        words = words.unionByName(part)
    return words.distinct().groupBy("stage").agg(F.count(F.lit(1)).alias("distinct_words"))


def distinct_words_of_columns(df: DataFrame, stages: dict[str, str]) -> DataFrame:
    """The same where the stages are columns of one table, in one pass over it."""
    words = [
        F.struct(F.lit(name).alias("stage"), F.array_distinct(whitespace_words(F.col(column))).alias("words"))
        for name, column in stages.items()
    ]
    rows = df.select(F.inline(F.array(*words))).select("stage", F.explode("words").alias("word"))
    return rows.distinct().groupBy("stage").agg(F.count(F.lit(1)).alias("distinct_words"))


def funnel(trace: DataFrame, stages: list[tuple[str, Column, Column]]) -> DataFrame:
    """Rows and bytes that reach each stage, with shares of the first stage.

    ``stages``: name, reached?, length of the content at that stage. One
    aggregate over one trace of the corpus replaces a scan per stage.
    """
    sums = trace.agg(
        *(F.count_if(reached).alias(f"rows_{i}") for i, (_, reached, _) in enumerate(stages)),
        *(
            F.sum(F.when(reached, F.col("size")).otherwise(0)).cast("bigint").alias(f"size_{i}")
            for i, (_, reached, _) in enumerate(stages)
        ),
        *(
            F.sum(F.when(reached, length).otherwise(0)).cast("bigint").alias(f"bytes_{i}")
            for i, (_, reached, length) in enumerate(stages)
        ),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(i).cast("bigint").alias("stage_no"), F.lit(name).alias("stage"),
                F.col(f"rows_{i}").alias("n_rows"), F.col(f"size_{i}").alias("declared_size"),
                F.col(f"bytes_{i}").alias("content_bytes"),
                F.round(F.col(f"rows_{i}") / F.col("rows_0") * 100, 6).alias("pct_of_rows"),
                F.round(F.col(f"bytes_{i}") / F.col("bytes_0") * 100, 6).alias("pct_of_bytes"),
            )
            for i, (name, _, _) in enumerate(stages)
        )
    )
    return sums.select(F.inline(rows))
