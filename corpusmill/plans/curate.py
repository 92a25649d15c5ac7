"""The whole curation run, from raw files to split tables and their funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.functions.staging import evaluate_once
from corpusmill.operators import anonymize as A
from corpusmill.operators import clean, dedup, eda, flags, split

MIN_LINES = 30
#: Where a unique file can end, in the order of the stages; each is an audit set of its own.
ROUTES = ("removed", "coq_suspect", "short", "quarantined", "identifier_heavy", "kept")


def _survivors(df: DataFrame) -> DataFrame:
    """Flagged rows; the content of rows to remove moves aside, so no rule runs on it."""
    rows = flags.flag(df).withColumnRenamed("coq_flag", "path_coq_flag")
    left = F.when(~F.col("remove_flag"), F.col("content"))
    return rows.withColumn("removed_content", F.when(F.col("remove_flag"), F.col("content"))).withColumn(
        "content", left
    )


def _both_flags(df: DataFrame) -> DataFrame:
    """The Coq flag of the path where a row is removed, else that of its text."""
    coq = F.when(F.col("remove_flag"), F.col("path_coq_flag")).otherwise(F.col("coq_flag"))
    return evaluate_once(df.withColumn("coq_flag", coq).drop("path_coq_flag"), "coq_flag")


def judge_flags(df: DataFrame) -> DataFrame:
    """All flags, at the cost of the half of cleaning that they need; ``content`` is left out."""
    scanned = clean.scan_keywords(_survivors(df)).drop("content", "removed_content", "code", "coq_keywords")
    return _both_flags(scanned)


def judge(df: DataFrame) -> DataFrame:
    """Flag by path and header, clean what is left, and join both Coq flags.

    Rows to remove keep their content without comments.
    """
    cleaned = clean.clean(_survivors(df))
    content = F.when(F.col("remove_flag"), F.col("removed_content")).otherwise(F.col("content"))
    return _both_flags(cleaned.withColumn("content", content).drop("removed_content"))


def curate(df: DataFrame, min_lines: int = MIN_LINES, seed: int = 42) -> DataFrame:
    """Acquired, unique, valid, long enough, anonymised, trimmed and split files.

    The only shuffle is the one of deduplication; everything after it is one
    stage of per-row expressions.
    """
    names = df.columns
    valid = flags.keep_valid(judge(dedup.deduplicate(flags.filter_acquisition(df))))
    long = flags.keep_long(valid, min_lines).select(*names)
    released = A.released(A.anonymize(long, seed)).select(*names)
    trimmed = flags.flag_identifier_heavy(released).filter(~F.col("remove")).select(*names)
    return split.assign_split(trimmed, seed=seed)


def routed(df: DataFrame, min_lines: int = MIN_LINES, seed: int = 42) -> DataFrame:
    """Each row with its ``route`` (one of ROUTES), ``reason`` and ``split``; one stage of per-row expressions.

    ``content`` is the text at the point where the row left: without comments
    for removed rows, cleaned for suspects and short ones, else anonymised.
    No rule runs on the text of a row that has left. ``reason`` says why a row
    was removed or quarantined.
    """
    names, c = df.columns, F.col
    rows = judge(df)
    left = (
        F.when(c("remove_flag"), "removed").when(c("coq_flag"), "coq_suspect")
        .when(flags.line_count(c("content")) < min_lines, "short")
    )
    rows = rows.withColumn("left", left).withColumn("aside", F.when(c("left").isNotNull(), c("content")))
    rows = rows.withColumn("content", F.when(c("left").isNull(), c("content")))
    rows = flags.flag_identifier_heavy(A.anonymize(evaluate_once(rows, "content", "left", "aside"), seed))
    route = F.coalesce("left", F.when(c("quarantine").isNotNull(), "quarantined").when(c("remove"), "identifier_heavy"), F.lit("kept"))
    reason = F.when(route == "removed", c("reason_code")).when(route == "quarantined", c("quarantine"))
    rows = rows.withColumn("route", route).withColumn("reason", reason)
    rows = rows.withColumn("content", F.when(c("left").isNull(), c("content")).otherwise(c("aside")))
    rows = evaluate_once(rows.select(*names, "route", "reason"), "content", "route", "reason")
    return split.assign_split(rows, seed=seed)


def write_routes(df: DataFrame, path: str, min_lines: int = MIN_LINES, seed: int = 42) -> dict[str, int]:
    """Curate once and write every audit set: a folder per route, and rows and bytes of each.

    All sets come from one job over the acquired, unique files; the counts are
    observed while it writes.
    """
    rows = routed(dedup.deduplicate(flags.filter_acquisition(df)), min_lines, seed)
    counts = []
    for name in ROUTES:
        here = F.col("route") == name
        counts += [
            F.count_if(here).alias(name),
            F.coalesce(F.sum(F.when(here, F.octet_length("content"))), F.lit(0)).alias(f"{name}_bytes"),
        ]
    observed = Observation("routes")
    rows.observe(observed, *counts).write.mode("overwrite").partitionBy("route").parquet(path)
    return observed.get


def trace(df: DataFrame, min_lines: int = MIN_LINES, seed: int = 42) -> DataFrame:
    """How far each row gets and how long its content is at each stage.

    Each stage works on what reached it: content that did not is put out of
    its way.
    """
    groups = dedup.copy_groups(flags.filter_acquisition(df)).filter("content_hash IS NOT NULL")
    first = groups.select(F.col("first.doc_id").alias("doc_id"), F.lit(True).alias("is_first"))
    rows = df.withColumn("raw_bytes", F.coalesce(F.octet_length("content"), F.lit(0)))
    rows = rows.withColumn("acquired", flags.acquirable())
    rows = rows.join(first, "doc_id", "left").withColumn("unique", F.col("is_first").isNotNull())
    rows = judge(rows.withColumn("content", F.when(F.col("unique"), F.col("content"))))
    valid = F.col("unique") & ~F.col("remove_flag") & ~F.col("coq_flag")
    rows = rows.withColumn("valid", valid)
    rows = rows.withColumn(
        "long", F.col("valid") & (flags.line_count(F.col("content")) >= min_lines)
    )
    rows = rows.withColumn("clean_bytes", F.octet_length("content"))
    rows = rows.withColumn("content", F.when(F.col("long"), F.col("content")))
    rows = A.anonymize(evaluate_once(rows, "content", "valid", "long", "clean_bytes"), seed)
    rows = rows.withColumn("released", F.col("long") & F.col("quarantine").isNull())
    rows = flags.flag_identifier_heavy(rows).withColumn("trimmed", F.col("released") & ~F.col("remove"))
    return rows.select(
        "doc_id", "size", "raw_bytes", "acquired", "unique", "valid", "long", "clean_bytes", "released",
        "trimmed", F.octet_length("content").alias("final_bytes"),
    )


def stage_funnel(traced: DataFrame) -> DataFrame:
    c = F.col
    return eda.funnel(
        traced,
        [
            ("raw", F.lit(True), c("raw_bytes")),
            ("acquired", c("acquired"), c("raw_bytes")),
            ("deduplicated", c("unique"), c("raw_bytes")),
            ("cleaned", c("valid"), c("clean_bytes")),
            ("long_enough", c("long"), c("clean_bytes")),
            ("anonymized", c("released"), c("final_bytes")),
            ("trimmed", c("trimmed"), c("final_bytes")),
        ],
    )
