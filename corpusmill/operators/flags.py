"""Row flags and filters. One cascade expression, one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import text as X
from corpusmill.functions.staging import evaluate_once

NULL_CONTENT = "NULL_CONTENT"
COQ_PATH = "COQ_PATH"
COQ_MODULE = "COQ_MODULE"
NON_SYNTH_PATH = "NON_SYNTH_PATH"
NO_MODULE = "NO_MODULE"
REASONS = (NULL_CONTENT, COQ_PATH, COQ_MODULE, NON_SYNTH_PATH, NO_MODULE)


def drop_null_content(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["content"])


def null_content_count(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("content").isNull()).alias("n_null"),
        F.count("content").alias("n_kept"),
    )


def full_path() -> Column:
    """``repo/path`` in lower case; a missing part reads ``None``."""
    parts = [F.coalesce(F.col(name), F.lit("None")) for name in ("repo_name", "path")]
    return F.lower(F.concat_ws("/", *parts))


def has_coq(lowered: Column) -> Column:
    return F.contains(lowered, F.lit("coq"))


def has_coq_path() -> Column:
    return has_coq(full_path())


def coq_module_header(text: Column) -> Column:
    """The matched header, or the empty text."""
    return F.regexp_extract(text, R.COQ_MODULE_REGEX, 0)


def first_contained(text: Column, words) -> Column:
    """The first word of the list that ``text`` contains, else null."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words))


def has_module(text: Column) -> Column:
    return X.has_module_header(text)


def flag(df: DataFrame, path_keywords=R.PATH_KEYWORDS) -> DataFrame:
    """Strip comments, then record the first removal reason that applies."""
    df = df.withColumn("is_null_content", F.col("content").isNull())
    df = df.withColumn("content", X.strip_comments(F.col("content")))
    text = F.col("content")
    cascade = [
        (F.col("is_null_content"), NULL_CONTENT, F.lit("")),
        (has_coq_path(), COQ_PATH, F.lit("coq")),
        (coq_module_header(text) != "", COQ_MODULE, coq_module_header(text)),
        (
            first_contained(full_path(), path_keywords).isNotNull(),
            NON_SYNTH_PATH,
            first_contained(full_path(), path_keywords),
        ),
        (~has_module(text), NO_MODULE, F.lit("")),
    ]
    reason = F.coalesce(
        *(
            F.when(test, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
            for test, code, detail in cascade
        )
    )
    df = df.withColumn("reason", reason)
    df = df.withColumn("reason_code", F.col("reason.code"))
    df = df.withColumn("reason_detail", F.col("reason.detail"))
    df = df.withColumn("remove_flag", F.col("reason_code").isNotNull())
    df = df.withColumn(
        "coq_flag", F.coalesce(F.col("reason_code").isin(COQ_PATH, COQ_MODULE), F.lit(False))
    )
    df = df.drop("reason", "is_null_content")
    return evaluate_once(
        df, "content", "reason_code", "reason_detail", "remove_flag", "coq_flag"
    )


def keep_valid(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("remove_flag") & ~F.col("coq_flag"))


def removed(df: DataFrame) -> DataFrame:
    return df.filter("remove_flag")


def coq_suspects(df: DataFrame) -> DataFrame:
    return df.filter(F.col("coq_flag") & ~F.col("remove_flag"))


def flags_left(df: DataFrame) -> DataFrame:
    """Rows, and those still flagged."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("remove_flag") | F.col("coq_flag")).alias("n_flagged"),
    )


def assert_no_flags(df: DataFrame) -> None:
    """Raise when a flagged row is left."""
    if flags_left(df).first()["n_flagged"]:
        raise ValueError("flagged rows are left after the filter")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def keep_long(df: DataFrame, min_lines: int = 30) -> DataFrame:
    return df.filter(line_count(F.col("content")) >= min_lines)


def short_file_sweep(df: DataFrame, thresholds=(6, 20, 30, 50)) -> DataFrame:
    """Rows and bytes kept per threshold, from one scan."""
    measured = df.select(line_count(F.col("content")).alias("n"), "size")
    total = measured.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.count_if(F.col("n") >= t).alias(f"rows_{t}") for t in thresholds),
        *(
            F.coalesce(F.sum(F.when(F.col("n") >= t, F.col("size"))), F.lit(0)).alias(f"bytes_{t}")
            for t in thresholds
        ),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(t).cast("bigint").alias("min_lines"), F.col(f"rows_{t}").alias("rows_kept"),
                F.col(f"bytes_{t}").alias("bytes_kept"),
                F.round(100 * (1 - F.col(f"rows_{t}") / F.col("n_rows")), 6).alias("rows_cut_pct"),
            )
            for t in thresholds
        )
    )
    return total.select(F.inline(rows))


def acquirable(licenses=R.PERMISSIVE_LICENSES, extensions=R.SOURCE_EXTENSIONS) -> Column:
    """Permissively licensed, with a source extension; false where either is unknown."""
    wanted = F.lower("license").isin(*licenses)
    for_ext = F.lit(False)
    for ext in extensions:
        for_ext = for_ext | F.endswith(F.col("path"), F.lit(ext))
    return F.coalesce(wanted & for_ext, F.lit(False))


def filter_acquisition(
    df: DataFrame, licenses=R.PERMISSIVE_LICENSES, extensions=R.SOURCE_EXTENSIONS
) -> DataFrame:
    """Permissively licensed files with a source extension."""
    return df.filter(acquirable(licenses, extensions))


# --- identifier-heavy files -----------------------------------------------

BANDS = (0.9, 0.8, 0.7, 0.6, 0.49)


def variable_share(text: Column, pattern: str = R.VARIABLE_REGEX) -> Column:
    """Characters in placeholder occurrences over all characters: what is gone without them."""
    total = F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return F.when(F.length(text) > 0, total / F.length(text))


def share_band(share: Column, bands=BANDS) -> Column:
    label = F.lit("kept")
    for bound in sorted(bands):
        label = F.when(share > bound, F.lit(f">{bound}")).otherwise(label)
    return F.when(share.isNull(), F.lit("empty")).otherwise(label)


def distinct_variables(text: Column, pattern: str = R.VARIABLE_REGEX) -> Column:
    return F.size(F.array_distinct(X.find_all(text, pattern)))


def flag_identifier_heavy(
    df: DataFrame, bands=BANDS, big_variable: str = R.BIG_VARIABLE_REGEX,
    min_distinct: int | None = None,
) -> DataFrame:
    """Empty content, a high placeholder share, or a big placeholder number.

    ``min_distinct`` tests the count of distinct placeholders instead of the
    number inside a name.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    big = (
        text.rlike(big_variable)
        if min_distinct is None
        else distinct_variables(text) >= min_distinct
    )
    # a filter on the verdict would run the text rules once per use of the share
    df = evaluate_once(
        df.withColumn("share", variable_share(text)).withColumn("big_variable", big), "share", "big_variable"
    )
    names = [name for name in df.columns if name not in ("band", "big_variable")]
    df = df.select(*names, share_band(F.col("share"), bands).alias("band"), "big_variable")
    return df.withColumn("remove", (F.col("band") != "kept") | F.col("big_variable"))
