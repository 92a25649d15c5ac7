"""Reason cascade, filters, identifier-heavy files, deduplication, splits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, flags, split

OK = "module m(input a);\nendmodule"


def test_cascade_first_reason_wins(corpus_of):
    df = corpus_of([
        ("r", "a.v", None), ("r", "coq/a.v", OK), ("r", "a.v", "module x . end;"),
        ("r", "rtl/simple.v", OK), ("r", "a.v", "wire x;"), ("r", "a.v", OK),
        ("r", "coq/tb.v", "module x ."), ("r", "TB/a.v", "wire y;"),
        ("r", "a.v", "// module m(a);\nwire x;"),
    ])
    rows = flags.flag(df).orderBy("doc_id").collect()
    assert [(r["reason_code"], r["reason_detail"]) for r in rows] == [
        ("NULL_CONTENT", ""), ("COQ_PATH", "coq"), ("COQ_MODULE", "module x ."),
        ("NON_SYNTH_PATH", "sim"), ("NO_MODULE", ""), (None, None), ("COQ_PATH", "coq"),
        ("NON_SYNTH_PATH", "tb"), ("NO_MODULE", ""),
    ]
    assert [r["coq_flag"] for r in rows] == [False, True, True] + [False] * 3 + [True] + [False] * 2


def test_missing_path_parts_read_none(spark):
    rows = spark.createDataFrame([(None, "A.v"), ("R", None)], "repo_name string, path string")
    assert [r[0] for r in rows.select(flags.full_path()).collect()] == ["none/a.v", "r/none"]


def test_no_flags_left(corpus_of):
    flagged = flags.flag(corpus_of({"a.v": OK, "coq/a.v": OK}))
    flags.assert_no_flags(flags.keep_valid(flagged))
    with pytest.raises(ValueError):
        flags.assert_no_flags(flagged)


def test_acquisition_filter(spark):
    rows = spark.createDataFrame(
        [("MIT", "a.v"), ("gpl-3.0", "a.v"), ("apache-2.0", "a.sv"), ("mit", "a.vhd"), (None, "a.v")],
        "license string, path string",
    )
    assert flags.filter_acquisition(rows).count() == 2


def test_share_bands_are_strict(spark):
    def exact(share):
        """``share`` characters of placeholders in a text of 100 characters."""
        return "VAR" + "1" * (share - 3) + " " * (100 - share)

    shares = [49, 50, 60, 61, 70, 80, 90, 91]
    rows = spark.createDataFrame([(i, exact(s)) for i, s in enumerate(shares)], "i int, content string")
    bands = [r["band"] for r in flags.flag_identifier_heavy(rows).orderBy("i").collect()]
    assert bands == ["kept", ">0.49", ">0.49", ">0.6", ">0.6", ">0.7", ">0.8", ">0.9"]


def test_big_variable(spark):
    texts = ["VAR99", "VAR100", "VAR1000", "VAR200", "XVAR100", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    flagged = flags.flag_identifier_heavy(rows).orderBy("i").collect()
    assert [r["big_variable"] for r in flagged] == [False, True, True, False, False, False]
    assert flagged[5]["band"] == "empty" and flagged[5]["remove"]


def test_short_file_sweep(corpus_of):
    df = corpus_of({"a": "x", "b": "x\n" * 5, "c": "x\n" * 29})
    rows = flags.short_file_sweep(df, (2, 30)).orderBy("min_lines").collect()
    assert [(r["min_lines"], r["rows_kept"]) for r in rows] == [(2, 2), (30, 1)]


def test_dedup_keeps_first_and_is_idempotent(corpus_of):
    df = corpus_of({"a": "x", "b": None, "c": "x", "d": "y", "e": "x"})
    once = dedup.deduplicate(df)
    assert sorted(r["path"] for r in once.collect()) == ["a", "d"]
    assert sorted(r["path"] for r in dedup.deduplicate(once).collect()) == ["a", "d"]
    report = dedup.reduction_report(df).first()
    assert (report["rows_read"], report["null_rows"], report["rows_after"]) == (5, 1, 2)


def test_split_is_a_partition_and_stable_under_append(spark):
    small = split.assign_split(spark.range(2000).withColumnRenamed("id", "doc_id"))
    large = split.assign_split(spark.range(4000).withColumnRenamed("id", "doc_id"))
    assert small.join(large, ["doc_id", "split"]).count() == 2000
    counts = dict(small.groupBy("split").count().collect())
    assert set(counts) == {"train", "test", "validation"} and abs(counts["test"] - 200) < 60


def test_dedup_with_repeated_and_null_keys(spark):
    rows = [(1, "a", 1), (1, "a", 1), (2, "b", 1), (2, "a", 1), (None, "x", 2), (3, "c", 1), (None, "x", 1), (None, None, 1),
            (4, None, 1), (6, "", 0), (5, "", 0), (None, "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, content string, size long").repartition(3)
    want = [(1, "a", 1), (2, "b", 1), (3, "c", 1), (5, "", 0), (None, "x", 1)]
    for bits in (dedup.MOST_BITS, 1 << 15):
        assert sorted(map(tuple, dedup.deduplicate(df, most_bits=bits).collect()), key=str) == sorted(want, key=str)
    assert dedup.deduplicate(df.limit(0)).count() == 0


def test_suspects_hold_all_copies_and_few_others(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id % 5000) AS content")
    marked = dedup.suspects(df).groupBy("content").agg(F.count("*").alias("n"), F.max("suspect").alias("suspect")).collect()
    assert all(row["suspect"] for row in marked if row["n"] > 1)
    assert sum(row["suspect"] for row in marked if row["n"] == 1) < 400
    # a bitmap with one bit per value at most still finds every copy
    assert dedup.deduplicate(df, most_bits=1 << 10).count() == 5000


def test_exact_split_with_repeated_and_null_keys(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "a"), (None, "x"), (3, "c"), (None, "y")] + [(i, "z") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, content string")
    done = split.assign_split_exact(df)
    assert sorted(map(tuple, done.drop("split").collect()), key=str) == sorted(rows, key=str)
    assert done.groupBy("doc_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    counts = dict(done.groupBy("split").count().collect())
    assert 6 <= counts["test"] <= 7 and 6 <= counts["validation"] <= 7  # ceil(5.7), ceil(51 / 9), a copy at a border
    assert split.assign_split_exact(df.limit(0)).count() == 0


def test_epoch_places_of_repeated_and_null_keys(spark):
    rows = [(i // 3 if i % 5 else None, f"t{i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, content string")
    placed = split.in_epoch_order(df.repartition(3), 1, 8, shards=3).collect()
    assert sorted((r["doc_id"], r["content"]) for r in placed if r["doc_id"] is not None) == sorted(r for r in rows if r[0] is not None)
    assert sorted(r["batch_no"] * 8 + r["slot"] for r in placed) == list(range(100))
    assert all(r["shard"] == r["batch_no"] % 3 for r in placed)


def test_exact_split_shares(spark):
    rows = split.assign_split_exact(spark.range(1001).withColumnRenamed("id", "doc_id"))
    assert dict(rows.groupBy("split").count().collect()) == {
        "test": 101, "validation": 100, "train": 800,
    }


def test_epoch_batches(spark):
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    first, again, other = (
        split.epoch_batches(docs, epoch, 8).orderBy("doc_id").collect() for epoch in (1, 1, 2)
    )
    assert first == again and first != other
    sizes = sorted(r["count"] for r in split.epoch_batches(docs, 1, 8).groupBy("batch_no").count().collect())
    assert sizes == [4] + [8] * 12


def test_sample_is_reproducible(spark):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    one, two = (split.seeded_sample(docs, 10).collect() for _ in range(2))
    assert one == two and split.seeded_sample(docs, 10, seed=1).collect() != one


def test_null_counts(corpus_of):
    row = flags.null_content_count(corpus_of({"a": "x", "b": None})).first()
    assert tuple(row) == (2, 1, 1)
    assert flags.drop_null_content(corpus_of({"a": "x", "b": None})).filter(F.lit(True)).count() == 1
