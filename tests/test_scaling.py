"""What keeps queries within time and memory as their tables grow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.operators import encode, flags, ngram
from corpusmill.sources import corpus as C
from corpusmill.sources import views as V


def _part(spark, path, n=40):
    rows = spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("red pin").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.lit("STANDARD").alias("p_type"), F.lit(7).alias("p_size"),
    )
    rows.coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_built_texts_are_spread_over_the_cores(spark, tmp_path):
    folder = _part(spark, tmp_path)
    for view in (V.vcorpus, V.varcorpus):
        rows = view(spark, folder)
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
        assert sum(row["count"] for row in sizes) == 40
        assert len(sizes) >= spark.sparkContext.defaultParallelism


def test_filter_on_heavy_files_runs_each_text_rule_once(spark, tmp_path):
    rows = flags.flag_identifier_heavy(V.varcorpus(spark, _part(spark, tmp_path)))
    plan = rows.filter("remove").select("doc_id")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_replace(") + plan.count("regexp_extract_all(") == 1
    assert plan.count("array_join(") == 1


def test_share_counts_the_characters_of_all_occurrences(texts):
    found = texts(flags.variable_share, ["VAR1 VAR22", "", None, "aVAR1 VAR", "VAR1\nVAR2é"])
    assert found == [9 / 10, None, None, 0.0, 4 / 10]


def test_encoding_works_on_bounded_runs_of_rows():
    lists = [["a"] * 4, None, [], ["b"] * 30, ["c"] * 3, ["d"] * 3, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string()))], ["k", "tokens"])
    cut = list(encode._slices(batch.slice(0), "tokens", 6))
    assert [part.column("k").to_pylist() for part in cut] == [[0, 1, 2], [3], [4, 5, 6]]
    later = list(encode._slices(batch.slice(4), "tokens", 3))
    assert [part.column("k").to_pylist() for part in later] == [[4], [5, 6]]
    assert list(encode._slices(batch.slice(0, 0), "tokens", 6)) == []


def test_training_is_counted_once_for_scores(corpus_of):
    docs = corpus_of({"a": "x y z x y", "b": "x y w"})
    plan = ngram.score_back_off(docs, docs, 3)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all(") == 2  # the test part, and how many tokens there are


def test_training_is_cut_into_tokens_once_for_scores(spark, corpus_of):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    train = corpus_of({"a": "x y z x y", "b": "x y w", "c": "x y", "d": "v"})
    heard = train.withColumn("content", told("content"))
    found = ngram.score_back_off(corpus_of({"t": "x y w"}), heard, 3).collect()
    assert read.value == 4  # every row once, for all orders and the number of tokens
    assert found == ngram.score_back_off(corpus_of({"t": "x y w"}), train, 3).collect()


def test_counts_are_read_once_for_predictions(corpus_of):
    docs = corpus_of({"a": "x y z x y", "b": "x y w"})
    contexts = ngram.ngram_counts(docs, 3).select("context")
    counts = {3: ngram.ngram_counts(docs, 3), 2: ngram.bigram_counts(docs)}
    found = ngram.predict_back_off(contexts, counts, ngram.unigram_counts(docs))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all(") <= 3  # the single tokens, not the orders
    assert {(r["context"], r["order"], r["rank"], r["next"]) for r in found.collect()} == {
        ("x y", 3, 1, "w"), ("x y", 3, 2, "z"), ("y z", 3, 1, "x"), ("z x", 3, 1, "y"),
    }


def test_small_files_share_tasks(spark, tmp_path):
    inputs = spark.range(100).select(F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("input_ids"))
    spark.sparkContext.setJobGroup("shards", "one file a row")
    try:
        manifest = C.write_shards(inputs, str(tmp_path / "s"), epoch=1, batch_size=1, shards=2, rows_per_file=1)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert manifest.where("n_rows = 1 and first_batch = last_batch").count() == 100
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("shards") for s in tracker.getJobInfo(job).stageIds]
    assert max(info.numTasks for s in stages if (info := tracker.getStageInfo(s))) < 100
