"""Every sink, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.tokens import pre_tokens
from corpusmill.operators import eda, flags, split
from corpusmill.operators import vocab as W
from corpusmill.plans import curate
from corpusmill.queries.base import Query, check
from corpusmill.queries.dedup import SPLIT_SQL
from corpusmill.queries.flagging import FLAGGED
from corpusmill.queries.reports import FUNNEL_STEPS, PRE
from corpusmill.queries.tokenizing import QUERIES as TOKENIZING
from corpusmill.schemas import ANONYMIZED
from corpusmill.session import shared_path
from corpusmill.sources import corpus as C
from corpusmill.sources import views as V


def _stage_output(spark, sf_dir):
    path = shared_path(spark, "stage")
    C.write_corpus(split.assign_split(V.corpus(spark, sf_dir)).select(*ANONYMIZED.names), path)
    return C.read_split(spark, path, *C.SPLITS).select("doc_id", "content", "split")


def _audit_set(spark, sf_dir):
    """The removed rows as CSV; their contents hold quotes, backslashes and line ends."""
    path = shared_path(spark, "audit")
    removed = flags.removed(flags.flag(V.vcorpus(spark, sf_dir))).select("doc_id", "path", "content", "reason_code")
    C.write_audit_csv(removed, path)
    back = C.read_audit_csv(spark, path, removed.schema)
    return back.select("doc_id", "path", F.coalesce("content", F.lit("")).alias("content"), "reason_code")


def _pre_tokenized(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("doc_id", pre_tokens(F.coalesce("content", F.lit(""))).alias("input_ids"))


def _token_counts(spark, sf_dir):
    path = shared_path(spark, "token-counts")
    C.write_token_counts(_pre_tokenized(spark, sf_dir), path)
    return spark.read.schema("doc_id long, n_tokens int").option("header", True).csv(path)


def _metrics(spark, sf_dir):
    path = shared_path(spark, "metrics")
    metrics = eda.totals(V.corpus(spark, sf_dir))
    C.write_metrics_json(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


def _vocabulary(spark, sf_dir):
    path = shared_path(spark, "vocabulary")
    vocab = TOKENIZING["X7_special_tokens_first"].build(spark, sf_dir)
    C.write_vocab(vocab, None, path)
    C.write_vocab_json(C.read_vocab(spark, path), f"{path}/json")
    return C.read_vocab_json(spark, f"{path}/json")


def _manifest(spark, sf_dir):
    """Token arrays of all documents as shards of files of at most 24 rows; what was written is counted."""
    return C.write_shards(
        _pre_tokenized(spark, sf_dir), shared_path(spark, "shards"), epoch=1, batch_size=8, rows_per_file=24
    )


def _routed_run(spark, sf_dir):
    """Every audit set of one run, as it was written."""
    path = shared_path(spark, "routes")
    curate.write_routes(V.vcorpus(spark, sf_dir), path, min_lines=10)
    return spark.read.parquet(path).groupBy("route", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


_TOKENS = f"coalesce(len(regexp_extract_all(content, '{PRE}')), 0)"

QUERIES = {
    "S4_stage_output": Query(
        _stage_output, check("corpus", f"SELECT doc_id, content, split FROM ({SPLIT_SQL}) s")
    ),
    "S5_audit_set": Query(
        _audit_set,
        check("vcorpus", "SELECT doc_id, path, content, reason_code FROM flagged WHERE reason_code IS NOT NULL", flagged=FLAGGED),
    ),
    "S6_token_counts": Query(
        _token_counts, check("corpus", f"SELECT doc_id, CAST({_TOKENS} AS INTEGER) AS n_tokens FROM corpus")
    ),
    "S7_metrics_json": Query(
        _metrics,
        check("corpus", "SELECT count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS n_bytes, "
              "round(sum(size) / 1073741824, 6) AS gib FROM corpus"),
    ),
    "S9_vocabulary": Query(_vocabulary, TOKENIZING["X7_special_tokens_first"].sql),
    "F10_routed_run": Query(
        _routed_run,
        check("vcorpus", """SELECT route, coalesce(CASE route WHEN 'removed' THEN reason_code WHEN 'quarantined' THEN quarantine END, '')
                  AS reason, count(*) AS n_rows
              FROM (SELECT CASE WHEN j.remove_flag THEN 'removed' WHEN j.coq_flag THEN 'coq_suspect'
                                WHEN NOT t.long THEN 'short' WHEN NOT t.free THEN 'quarantined'
                                WHEN t.heavy THEN 'identifier_heavy' ELSE 'kept' END AS route, j.reason_code, f.quarantine
                    FROM trace t JOIN judged j ON j.doc_id = t.doc_id JOIN final f ON f.doc_id = t.doc_id WHERE t.uniq) r
              GROUP BY ALL""", **FUNNEL_STEPS),
    ),
    "K7_shard_manifest": Query(
        _manifest,
        check("corpus", f"""SELECT shard, (b // 8) // 3 AS file, min(b) AS first_batch, max(b) AS last_batch,
                  count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens
              FROM (SELECT r // 8 AS b, (r // 8) % 8 AS shard, n
                    FROM (SELECT {_TOKENS} AS n, row_number() OVER
                              (ORDER BY sha256('42:1:' || doc_id), doc_id) - 1 AS r FROM corpus) k) s
              GROUP BY shard, (b // 8) // 3"""),
    ),
}
