"""Scans, licence filter, deduplication, distinct sets and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import text as X
from corpusmill.operators import clean, dedup, flags, split
from corpusmill.queries.base import Query, check, listed, values
from corpusmill.queries.cleaning import AUDIT_SQL, CLEAN_STAGES, CODE, FRAGMENTS, MASKED
from corpusmill.schemas import ANONYMIZED
from corpusmill.session import shared_path
from corpusmill.sources import corpus as C
from corpusmill.sources import views as V


def _with_split(spark, sf_dir):
    return split.assign_split(V.corpus(spark, sf_dir))


SPLIT_SQL = """
    SELECT *, CASE WHEN b < 100 THEN 'test' WHEN b < 200 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT *, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) % 1000 AS b
          FROM corpus) h"""


def _read_split(spark, sf_dir):
    """A table partitioned by split, of which one folder is read."""
    path = shared_path(spark, "splits")
    C.write_corpus(_with_split(spark, sf_dir).select(*ANONYMIZED.names), path)
    return C.read_split(spark, path, "train").select("doc_id", "path")


def _union(spark, sf_dir):
    whole = _with_split(spark, sf_dir)
    parts = {name: whole.filter(F.col("split") == name).drop("split") for name in C.SPLITS}
    return C.union_splits(parts).select("doc_id", "path", "split")


def _banned_usage(spark, sf_dir):
    words = R.banned_words()
    hits = V.vcorpus(spark, sf_dir).filter("content IS NOT NULL").select(
        F.explode(
            F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("content"), w))
        ).alias("word")
    )
    counted = hits.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    table = spark.createDataFrame(list(enumerate(words)), "ord int, word string")
    return table.join(counted, "word", "left").select(
        F.col("ord").cast("bigint").alias("ord"), "word",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
    )


_BANNED_SQL = f"""
SELECT CAST(b.ord AS BIGINT) AS ord, b.word, count(v.doc_id) AS n_docs
FROM (SELECT row_number() OVER (ORDER BY first_place) - 1 AS ord, word
      FROM (SELECT word, min(ord) AS first_place
            FROM {values([w for words in R.BANNED_WORD_LISTS for w in words])} t(ord, word)
            GROUP BY word) d) b
LEFT JOIN vcorpus v ON contains(v.content, b.word)
GROUP BY b.ord, b.word"""


QUERIES = {
    "S1_read_corpus": Query(
        lambda spark, d: V.corpus(spark, d), check("corpus", "SELECT * FROM corpus")
    ),
    "S2_read_split": Query(
        _read_split,
        check("corpus", f"SELECT doc_id, path FROM ({SPLIT_SQL}) s WHERE split = 'train'"),
    ),
    "S3_union_splits": Query(
        _union, check("corpus", f"SELECT doc_id, path, split FROM ({SPLIT_SQL}) s")
    ),
    "S8_fragment_log": Query(
        lambda spark, d: clean.fragment_log(V.vcorpus(spark, d)),
        check(
            "vcorpus",
            "SELECT doc_id, 'non_synthesizable_regex' AS rule_set, rule, fragment FROM fragments",
            code=CODE, masked=MASKED, fragments=FRAGMENTS,
        ),
    ),
    "S8_audit_log": Query(
        lambda spark, d: clean.audit_log(V.vcorpus(spark, d)),
        check("vcorpus", AUDIT_SQL, **CLEAN_STAGES),
    ),
    "S10_licence_filter": Query(
        lambda spark, d: flags.filter_acquisition(V.corpus(spark, d)).select(
            "doc_id", "path", "license"
        ),
        check(
            "corpus",
            f"SELECT doc_id, path, license FROM corpus "
            f"WHERE list_contains({listed(R.PERMISSIVE_LICENSES)}, lower(license)) "
            r"AND regexp_matches(path, '\.s?v$')",
        ),
    ),
    "D1_drop_exact_copies": Query(
        lambda spark, d: dedup.deduplicate(V.corpus(spark, d)).select("doc_id", "size", "content"),
        check(
            "corpus",
            "SELECT doc_id, size, content FROM corpus WHERE content IS NOT NULL "
            "QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id) = 1",
        ),
    ),
    "D2_hash_dedup": Query(
        lambda spark, d: dedup.deduplicate(V.vcorpus(spark, d)).select("doc_id", "path", "size"),
        check(
            "vcorpus",
            "SELECT doc_id, path, size FROM vcorpus WHERE doc_id IN "
            "(SELECT min(doc_id) FROM vcorpus WHERE content IS NOT NULL GROUP BY sha256(content))",
        ),
    ),
    "D3_reduction_report": Query(
        lambda spark, d: dedup.reduction_report(V.vcorpus(spark, d)),
        check(
            "vcorpus",
            """SELECT count(*) AS rows_read, count(*) FILTER (content IS NULL) AS null_rows,
                   count(*) FILTER (keep) AS rows_after,
                   round(100 * (1 - count(*) FILTER (keep) / count(*)), 6) AS row_cut_pct,
                   CAST(sum(size) AS BIGINT) AS bytes_before,
                   CAST(sum(size) FILTER (keep) AS BIGINT) AS bytes_after,
                   round(100 * (sum(size) - sum(size) FILTER (keep)) / sum(size), 6) AS size_cut_pct
            FROM (SELECT *, content IS NOT NULL AND row_number() OVER
                         (PARTITION BY content ORDER BY doc_id) = 1 AS keep FROM vcorpus) k""",
        ),
    ),
    "D4_duplicate_clusters": Query(
        lambda spark, d: dedup.duplicate_clusters(V.corpus(spark, d)),
        check(
            "corpus",
            "SELECT sha256(content) AS content_hash, min(doc_id) AS first_id, count(*) AS copies "
            "FROM corpus WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        ),
    ),
    "D5_distinct_identifiers": Query(
        lambda spark, d: V.vcorpus(spark, d)
        .select(F.explode(X.find_all(F.col("content"), r"[A-Za-z_][A-Za-z0-9_]*")).alias("word"))
        .distinct(),
        check(
            "vcorpus",
            "SELECT DISTINCT unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS word "
            "FROM vcorpus",
        ),
    ),
    "U3_banned_word_union": Query(_banned_usage, check("vcorpus", _BANNED_SQL)),
}
