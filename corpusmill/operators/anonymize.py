"""Identifier anonymisation. All of it is per document and needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import identifiers as I
from corpusmill.functions.staging import evaluate_once

FOUND = (
    "code", "identifiers", "id_count", "literals", "module_names", "submodule_names",
    "variable_names",
)
KINDS = {"module": "MODULE", "submodule": "SUBMODULE", "variable": "VAR"}


def extract_names(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the stripped code and the names of each kind found in it."""
    c = F.col
    df = df.withColumn("code", I.strip_underscores_except(F.coalesce(c(content), F.lit(""))))
    df = df.withColumn("module_names", I.module_names(c("code")))
    df = df.withColumn("code", I.with_dummy_module(c("code"), c("module_names")))
    df = df.withColumn(
        "module_names",
        F.when(F.size("module_names") == 0, F.array(F.lit(I.DUMMY_MODULE))).otherwise(
            c("module_names")
        ),
    )
    df = df.withColumn("identifiers", I.identifiers(c("code")))
    df = df.withColumn("id_count", F.size("identifiers").cast("bigint"))
    df = df.withColumn("literals", I.number_texts(c("code")))
    df = df.withColumn("instances", I.instance_names(c("code"), c("module_names")))
    df = df.withColumn(
        "submodule_names", F.array_except(I.without("instances", I.RESERVED), c("module_names"))
    ).drop("instances")
    df = df.withColumn(
        "variable_names",
        I.renameable("identifiers", "literals", "module_names", "submodule_names"),
    )
    return evaluate_once(df, *FOUND)


def rename_plan(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Add ``renames``: per document a bijection from names to placeholders.

    Placeholders of a kind are exactly 1..k; which name gets which follows a
    seeded hash, so neither position nor spelling leaks. Meaningful module and
    submodule names keep their word instead of getting a placeholder, numbered
    together and apart from every identifier of the file.
    """
    c = F.col
    df = df.withColumn(
        "kept_names",
        I.meaningful_renames(F.concat("module_names", "submodule_names"), c("identifiers")),
    )
    for kind in KINDS:
        names = I.without(f"{kind}_names", R.MEANINGFUL_WORDS)
        names = I.seeded_order(F.array_except(names, c("kept_names")["name"]), seed, c(key))
        df = df.withColumn(f"{kind}_renames", I.numbered(names, KINDS[kind]))
    return df.withColumn(
        "renames",
        F.concat("kept_names", *(f"{kind}_renames" for kind in KINDS)),
    )


def rewrite(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Add ``code``, the content with every planned rename applied at once."""
    df = rename_plan(extract_names(df), seed, key)
    df = evaluate_once(df.withColumn("lookup", I.rename_lookup(F.col("renames"))), "lookup")
    return df.withColumn("code", I.apply_renames(F.col("code"), F.col("lookup")))


def anonymize(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Rewrite ``content``; add ``id_count``, ``aberrant`` and ``quarantine``.

    Instead of ending the job, a document without identifiers, with two names
    that would become one, or with an identifier that no rule explains carries
    a quarantine reason.
    """
    c = F.col
    kept = df.columns
    df = rewrite(df, seed, key)
    known = R.VERILOG_KEYWORDS + R.MEANINGFUL_WORDS
    df = df.withColumn("residual", F.array_distinct(I.identifiers(c("code"))))
    residual = F.array_except(I.without("residual", known), c("renames")["replacement"])
    df = df.withColumn("residual", F.array_except(residual, c("literals")))
    banned = I.within("residual", R.NON_SYNTHESIZABLE_WORDS + R.PATH_KEYWORDS)
    df = df.withColumn("banned", banned)
    df = df.withColumn("aberrant", F.array_except(c("residual"), c("banned")))
    df = df.withColumn("content", I.blank_lines_with(c("code"), c("banned")))
    df = df.withColumn(
        "quarantine",
        F.when(c("id_count") == 0, F.lit("NO_IDENTIFIERS"))
        .when(collides(), F.lit("RENAME_COLLISION"))
        .when(F.size("aberrant") > 0, F.lit("ABERRANT_IDENTIFIER")),
    )
    df = df.select(*kept, "id_count", "banned", "aberrant", "quarantine")
    return evaluate_once(df, "content", "id_count", "banned", "aberrant", "quarantine")


def collides() -> Column:
    """Two names become one: a repeated replacement, or one that an unrenamed identifier has."""
    replacements = F.col("renames")["replacement"]
    staying = F.array_except("identifiers", F.col("renames")["name"])
    repeated = F.size(F.array_distinct(replacements)) < F.size(replacements)
    return repeated | F.arrays_overlap(replacements, staying)


def rename_rows(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """The rename plan in long form ``(key, kind, name, replacement)``."""
    planned = rename_plan(extract_names(df), seed, key)

    def tagged(kind: str, column: str):
        return F.transform(
            F.col(column),
            lambda e: F.struct(
                F.lit(kind).alias("kind"), e["name"].alias("name"),
                e["replacement"].alias("replacement"),
            ),
        )

    groups = [("kept", "kept_names")] + [(kind, f"{kind}_renames") for kind in KINDS]
    rows = [tagged(kind, column) for kind, column in groups]
    return planned.select(key, F.inline(F.concat(*rows)))


def assert_bijection(renames: DataFrame, key: str = "doc_id") -> None:
    """Raise when a document maps two names to one placeholder."""
    broken = (
        renames.groupBy(key, "replacement").count().filter("count > 1").limit(1).count()
    )
    if broken:
        raise ValueError("a placeholder stands for two names")


def released(df: DataFrame) -> DataFrame:
    return df.filter(F.col("quarantine").isNull()).drop(
        "id_count", "banned", "aberrant", "quarantine"
    )


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.col("quarantine").isNotNull())


def compare_sample(
    original: DataFrame, changed: DataFrame, n: int, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """Before and after of ``n`` seeded documents, joined on their key.

    The sample is drawn from the keys alone, so the join moves n texts.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    keys = changed.select(key).orderBy(order, key).limit(n)
    before = original.select(key, F.col("content").alias("original_content"))
    return (
        keys.join(before, key).join(changed.select(key, "content"), key)
    )
