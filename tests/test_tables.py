"""Sources, sinks, the whole run, and the same run on a stream."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusmill.operators import clean, eda, flags, split
from corpusmill.plans import curate
from corpusmill.rules import RULE_SETS, rules_table
from corpusmill.schemas import ANONYMIZED, CORPUS
from corpusmill.sources import corpus as C
from corpusmill.sources import views as V
from corpusmill.streaming import curate as stream


def test_formats_round_trip(spark, corpus_of, tmp_path):
    df = corpus_of({"a.v": 'x, "y"\nz\\', "b.v": "", "c.v": "plain"})
    df.write.parquet(f"{tmp_path}/p")
    df.write.json(f"{tmp_path}/j")
    C.write_audit_csv(df, f"{tmp_path}/c")
    expected = sorted(map(tuple, df.select("doc_id", "path", "content").collect()))
    for fmt, name in (("parquet", "p"), ("json", "j"), ("csv", "c")):
        back = C.read_corpus(spark, f"{tmp_path}/{name}", fmt).select(
            "doc_id", "path", F.coalesce("content", F.lit(""))
        )
        assert sorted(map(tuple, back.collect())) == expected, fmt


def test_split_table_prunes_and_unions(spark, sf_dir, tmp_path):
    whole = split.assign_split(V.corpus(spark, sf_dir))
    C.write_corpus(whole.select(*ANONYMIZED.names), str(tmp_path / "t"))
    train = C.read_split(spark, str(tmp_path / "t"), "train")
    plan = spark._jvm.PythonSQLUtils.explainString(train._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*split#\d+ = train", plan)
    assert train.count() == whole.where("split = 'train'").count()
    parts = {name: C.read_split(spark, str(tmp_path / "t"), name).drop("split") for name in C.SPLITS}
    assert C.union_splits(parts).count() == whole.count()


def test_metric_and_audit_sinks(spark, corpus_of, tmp_path):
    df = flags.flag(corpus_of({"a.v": "module m(a);\nendmodule", "tb/b.v": "x"}))
    cleaned = clean.clean(df)
    C.write_audit_csv(flags.removed(cleaned), f"{tmp_path}/removed")
    assert spark.read.csv(f"{tmp_path}/removed", header=True).count() == 1
    C.write_metrics_json(eda.totals(df), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first()["n_rows"] == 2


def test_rules_table_counts(spark):
    rows = rules_table(spark).groupBy("rule_set").count().collect()
    assert {r[0]: r[1] for r in rows} == {name: len(words) for name, (words, _) in RULE_SETS.items()}
    assert len(RULE_SETS["verilog_keyword"][0]) == 238


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = V.vcorpus(spark, sf_dir).filter("content IS NOT NULL")
    source.select(*CORPUS.names).write.parquet(f"{tmp_path}/in")
    rows = stream.curate_rows(stream.read_files(spark, f"{tmp_path}/in"), min_lines=10)
    query = stream.write_splits(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    streamed = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "content", "split")
    batch = stream.curate_rows(spark.read.schema(CORPUS).parquet(f"{tmp_path}/in"), min_lines=10)
    batch = batch.filter("quarantine IS NULL").select("doc_id", "content", "split")
    assert streamed.count() > 0
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_whole_run(spark, sf_dir):
    source = V.vcorpus(spark, sf_dir)
    done = curate.curate(source, min_lines=10)
    assert set(done.columns) == set(source.columns) | {"split"}
    funnel = curate.stage_funnel(curate.trace(source, min_lines=10)).orderBy("stage_no").collect()
    assert done.count() == funnel[-1]["n_rows"]
    counts = [row["n_rows"] for row in funnel]
    assert counts == sorted(counts, reverse=True)


def test_routes_of_one_run(spark, sf_dir, tmp_path):
    """All audit sets by one write; counts as observed, as read back, and as the separate stages give them."""
    source = V.vcorpus(spark, sf_dir)
    observed = curate.write_routes(source, f"{tmp_path}/r", min_lines=10)
    table = spark.read.parquet(f"{tmp_path}/r")
    found = {r["route"]: (r["n"], r["b"]) for r in table.groupBy("route").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("b")).collect()}
    assert {name: (observed[name], observed[f"{name}_bytes"]) for name in curate.ROUTES if observed[name]} == {
        name: (n, b or 0) for name, (n, b) in found.items()
    }
    funnel = {r["stage"]: r["n_rows"] for r in curate.stage_funnel(curate.trace(source, min_lines=10)).collect()}
    assert funnel["deduplicated"] == table.count() and funnel["trimmed"] == observed["kept"]
    assert funnel["cleaned"] == sum(observed[r] for r in ("short", "quarantined", "identifier_heavy", "kept"))
    done = curate.curate(source, min_lines=10).select("doc_id", "content", "split")
    kept = table.where("route = 'kept'").select("doc_id", "content", "split")
    assert kept.count() and sorted(map(tuple, kept.collect())) == sorted(map(tuple, done.collect()))


def test_stream_releases_what_the_whole_run_does(spark, sf_dir, tmp_path):
    from corpusmill.operators import dedup

    unique = dedup.deduplicate(V.vcorpus(spark, sf_dir)).select(*CORPUS.names)
    unique.write.parquet(f"{tmp_path}/in")
    rows = stream.curate_rows(stream.read_files(spark, f"{tmp_path}/in"), min_lines=10)
    stream.write_splits(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    streamed = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "content", "split")
    batch = curate.curate(spark.read.parquet(f"{tmp_path}/in"), min_lines=10).select("doc_id", "content", "split")
    assert streamed.count() and sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_cleaning_plan_has_no_shuffle_and_one_scan(spark, sf_dir, tmp_path):
    V.vcorpus(spark, sf_dir).write.parquet(f"{tmp_path}/v")
    plan = clean.clean(spark.read.parquet(f"{tmp_path}/v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_dedup_groups_never_shuffle_bodies(spark, sf_dir, tmp_path):
    from corpusmill.operators import dedup

    V.corpus(spark, sf_dir).write.parquet(f"{tmp_path}/c")
    report = dedup.reduction_report(spark.read.parquet(f"{tmp_path}/c"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "hashpartitioning(" in line]
    assert shuffled and all("content#" not in line for line in shuffled)


def test_dedup_moves_only_bodies_that_may_have_a_copy(spark, tmp_path):
    """Rows without a copy reach the result through no exchange; suspects are aggregated before theirs."""
    from corpusmill.operators import dedup

    texts = [(i, f"body {i}") for i in range(300)] + [(1000 + i, "copy") for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, content string").write.parquet(f"{tmp_path}/c")
    done = dedup.deduplicate(spark.read.parquet(f"{tmp_path}/c"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    alone = plan.split("Union", 1)[1].split("first#", 1)[0]
    assert all("content#" not in line for line in alone.split("\n") if "Exchange " in line and "Broadcast" not in line)
    assert "hashpartitioning(doc_id" not in plan and "SortMergeJoin" not in plan
    assert done.count() == 301
    assert dedup.suspects(spark.read.parquet(f"{tmp_path}/c")).where("suspect AND content != 'copy'").count() < 10


def test_vocabulary_shard_and_count_sinks(spark, corpus_of, tmp_path):
    import json

    from corpusmill.operators import encode
    from corpusmill.operators import vocab as W

    docs = corpus_of({f"{i}.v": f"module m{i}; wire \"é\\{i}\"; endmodule" for i in range(20)})
    vocab = W.word_vocabulary(W.pre_token_counts(docs), ("[UNK]", "[PAD]"), 30)
    C.write_vocab_json(vocab, f"{tmp_path}/vocab")
    (file,) = (tmp_path / "vocab").glob("part-*")
    ids = json.loads(file.read_text())
    assert ids == {r["token"]: r["id"] for r in vocab.collect()}
    assert {r["token"]: r["id"] for r in C.read_vocab_json(spark, f"{tmp_path}/vocab").collect()} == ids
    encoded = encode.encode_corpus(docs, encode.word_tokenizer(vocab, ("[UNK]", "[PAD]"), 30))
    C.write_token_counts(encoded, f"{tmp_path}/counts")
    counts = spark.read.csv(f"{tmp_path}/counts", header=True)
    lengths = {str(r["doc_id"]): str(len(r["input_ids"])) for r in encoded.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == lengths
    C.write_shards(encode.model_inputs(encoded, 1, 16), f"{tmp_path}/shards", epoch=1, batch_size=3, shards=2)
    shards = spark.read.parquet(f"{tmp_path}/shards/data")
    assert shards.count() == 20 and shards.where("shard != batch_no % 2").count() == 0
    first = [(r["batch_no"], r["slot"]) for r in spark.read.parquet(f"{tmp_path}/shards/data/shard=0").collect()]
    assert first == sorted(first)


def test_shards_are_files_of_whole_batches_under_a_budget(spark, tmp_path):
    """Ten times the rows are ten times the files; every row is in one of them, also with odd keys."""
    for rows in (400, 4000):
        df = spark.range(rows).selectExpr(
            "CASE WHEN id % 3 > 0 THEN id DIV 2 END AS doc_id", "id AS row", "transform(sequence(1, int(id % 5)), x -> x) AS input_ids"
        )
        path = f"{tmp_path}/{rows}"
        manifest = C.write_shards(df, path, epoch=2, batch_size=8, shards=3, rows_per_file=50).collect()
        assert all(m["n_rows"] <= 48 for m in manifest) and sum(m["n_rows"] for m in manifest) == rows
        assert len(manifest) == sum(-(-len(range(s, -(-rows // 8), 3)) // 6) for s in range(3))
        found = C.read_shard(spark, path, 0).unionByName(C.read_shard(spark, path, 1)).unionByName(C.read_shard(spark, path, 2))
        assert sorted(r["row"] for r in found.select("row").collect()) == list(range(rows))
        for m in manifest:
            (part,) = (tmp_path / f"{rows}/data/shard={m['shard']}/file={m['file']}").glob("part-*")
            places = [(r["batch_no"], r["slot"]) for r in spark.read.parquet(str(part)).collect()]
            assert places == sorted(places) and len(places) == m["n_rows"]
            assert (places[0][0], places[-1][0]) == (m["first_batch"], m["last_batch"])
    assert C.write_shards(df.limit(0), f"{tmp_path}/none", epoch=1, batch_size=8).count() == 0


def test_audit_log_has_every_rule_set(corpus_of):
    code = (
        "`timescale 1ns/1ps\nmodule m(input clk);\n`oddity x\n#5 a = 1;\n$display(x);\ninitial begin\na = 1;\nend\n"
        "specify\n(a => b) = 1;\nendspecify\nTheorem x : y.\ninclude \"x.vh\"\na =\nendmodule\n"
    )
    rows = clean.audit_log(corpus_of({"a.v": code})).collect()
    assert {r["rule_set"] for r in rows} == {
        "directive", "non_synthesizable_regex", "unknown_directive", "initial_block", "marked_block",
        "coq_keyword", "single_line", "incomplete_assignment",
    }
    by = {}
    for r in rows:
        by.setdefault(r["rule_set"], []).append(r["fragment"])
    assert by["initial_block"] == ["initial begin", "a = 1;", "end"]
    assert by["incomplete_assignment"] == ["a ="]
