"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with
all their columns; ``run`` writes each result as Parquet in the shared folder
and reads it again as the next stage's input. The last stage returns the drawn
copies of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import chunk_dedup, decontaminate, mixing, near_dedup, quality
from corpusmill.llm.shared import new_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; it learns from labelled ones among them."""
    ranking = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, ranking)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return chunk_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 or more on five-word shingles."""
    return near_dedup.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by source weights of the sharpest temperature without heavy repeats."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixture),
]

#: The learnt ranking has no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
