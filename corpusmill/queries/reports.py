"""Aggregations, distinct counts, samples, splits and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.tokens import pre_tokens
from corpusmill.operators import anonymize as A
from corpusmill.operators import clean, eda, flags, split
from corpusmill.plans import curate
from corpusmill.queries.anonymizing import _ORDER, ON_CLEANED, source
from corpusmill.queries.base import Query, check
from corpusmill.queries.cleaning import (
    _AUDIT_SQL, CLEAN_STAGES, _comments, _directives, _endings,
)
from corpusmill.queries.dedup import SPLIT_SQL
from corpusmill.queries.flagging import FLAGGED, HEAVY, JUDGED_STAGES, flagged, heavy
from corpusmill.sources import views as V

GAP = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
WORDS = f"list_filter(regexp_split_to_array(content, '{GAP}'), lambda w: w <> '')"
# Java's Unicode word characters, spelled for the check's regex engine.
PRE = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]+"

VARS = """
    SELECT var, count(*) AS n, min(doc_id * 1000000 + place) AS seen FROM (
        SELECT doc_id, unnest(vars) AS var, generate_subscripts(vars, 1) AS place
        FROM (SELECT *, regexp_extract_all(content, '\\bVAR[0-9]+\\b') AS vars FROM varcorpus
              WHERE split = 'train') v) u GROUP BY var"""
WORD_FREQ = f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM corpus) w GROUP BY word"

# --- the funnel in SQL: every stage's steps, then filtered aggregates
STRIPPED_FIRST = f"""
    SELECT doc_id, {_comments(_directives(_endings(_comments("coalesce(content, '')"))))} AS code
    FROM vcorpus"""
TRACE = """
    SELECT v.doc_id, v.size, strlen(coalesce(v.content, '')) AS raw_bytes,
           strlen(c.content) AS clean_bytes, strlen(f.content) AS final_bytes,
           v.acq, v.acq AND v.content IS NOT NULL
               AND row_number() OVER (PARTITION BY v.acq, v.content ORDER BY v.doc_id) = 1 AS uniq,
           f.content = '' OR regexp_matches(f.content, '\\bVAR1[0-9]{2,}\\b')
               OR coalesce(list_sum(list_transform(regexp_extract_all(f.content, '\\bVAR[0-9]+\\b'),
                                                   lambda x: length(x))), 0) / length(f.content) > 0.49 AS heavy,
           NOT j.remove_flag AND NOT j.coq_flag AS ok,
           len(string_split(c.content, chr(10))) >= 10 AS long, f.quarantine IS NULL AS free
    FROM (SELECT *, coalesce(lower(license) IN ('mit', 'bsd-2-clause', 'bsd-3-clause', 'apache-2.0')
                 AND (path LIKE '%.v' OR path LIKE '%.sv'), false) AS acq FROM vcorpus) v
    JOIN cleaned c ON c.doc_id = v.doc_id JOIN judged j ON j.doc_id = v.doc_id
    JOIN final f ON f.doc_id = v.doc_id"""
_REACHED = (
    ("raw", "true", "raw_bytes"), ("acquired", "acq", "raw_bytes"),
    ("deduplicated", "uniq", "raw_bytes"),
    ("cleaned", "uniq AND ok", "clean_bytes"),
    ("long_enough", "uniq AND ok AND long", "clean_bytes"),
    ("anonymized", "uniq AND ok AND long AND free", "final_bytes"),
    ("trimmed", "uniq AND ok AND long AND free AND NOT heavy", "final_bytes"),
)
FUNNEL = " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS stage_no, '{name}' AS stage,
               count(*) FILTER ({test}) AS n_rows,
               CAST(coalesce(sum(size) FILTER ({test}), 0) AS BIGINT) AS declared_size,
               CAST(coalesce(sum({length}) FILTER ({test}), 0) AS BIGINT) AS content_bytes,
               round(count(*) FILTER ({test}) / count(*) * 100, 6) AS pct_of_rows,
               round(coalesce(sum({length}) FILTER ({test}), 0) / sum(raw_bytes) * 100, 6)
                   AS pct_of_bytes FROM trace"""
    for i, (name, test, length) in enumerate(_REACHED)
)
FUNNEL_STEPS = (
    JUDGED_STAGES | {"code": STRIPPED_FIRST} | ON_CLEANED | {"trace": TRACE}
)


def _variables(spark, sf_dir):
    return eda.variable_frequencies(V.varcorpus(spark, sf_dir))


def _words(spark, sf_dir):
    return eda.word_frequencies(V.corpus(spark, sf_dir))


def _token_counts(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "doc_id", F.size(pre_tokens(F.col("content"))).alias("n_tokens")
    )


def _stages(spark, sf_dir):
    """One scan: each stage's content is a column beside the others."""
    rows = V.vcorpus(spark, sf_dir).withColumn("raw", F.col("content"))
    rows = clean.clean(rows).withColumnRenamed("content", "cleaned")
    rows = clean.code_text(rows, "raw").withColumnRenamed("code", "content")
    rows = A.anonymize(rows.select("doc_id", "raw", "cleaned", "content"))
    anonymized = F.when(F.col("raw").isNotNull(), F.col("content"))
    rows = rows.select("raw", "cleaned", anonymized.alias("anonymized"))
    return eda.distinct_words_of_columns(rows, {name: name for name in rows.columns})


def _unbalanced(spark, sf_dir):
    """Unbalanced files and leftover lines of the cleaned text, in one pass."""
    cleaned = clean.clean(V.vcorpus(spark, sf_dir))
    return cleaned.agg(
        F.count_if("unbalanced").alias("n_unbalanced"),
        F.sum(F.size(X.leftover_hits(F.col("content")))).alias("n_leftover"),
    )


_LEFT = _AUDIT_SQL.replace("FROM vcorpus", "FROM cleaned")


def _docs(spark, sf_dir):
    return V.corpus(spark, sf_dir)


def _exact(spark, sf_dir):
    return split.assign_split_exact(_docs(spark, sf_dir).select("doc_id"))


QUERIES = {
    "A1_totals": Query(
        lambda spark, d: eda.totals(_docs(spark, d)),
        check("corpus", "SELECT count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS n_bytes, "
              "round(sum(size) / 1073741824, 6) AS gib FROM corpus"),
    ),
    "A2_reduction_pct": Query(
        lambda spark, d: eda.reduction_of_kept(
            flagged(spark, d), ~F.col("remove_flag")
        ),
        check("vcorpus", """SELECT *, CAST(ceil((rows_before - rows_after) / rows_before * 100) AS BIGINT)
                  AS row_cut_pct, round((bytes_before - bytes_after) / bytes_before * 100, 2)
                  AS size_cut_pct
              FROM (SELECT count(*) AS rows_before, count(*) FILTER (reason_code IS NULL) AS rows_after,
                           CAST(sum(size) AS BIGINT) AS bytes_before,
                           CAST(sum(size) FILTER (reason_code IS NULL) AS BIGINT) AS bytes_after
                    FROM flagged) s""", flagged=FLAGGED),
    ),
    "A3_reason_counts": Query(
        lambda spark, d: eda.reason_counts(
            flagged(spark, d), (*flags.REASONS, "PREPROCESSING_FAILURE")
        ),
        check("vcorpus", """SELECT r.reason_code, count(f.doc_id) AS n_rows,
                  round(count(f.doc_id) / (SELECT count(*) FROM flagged) * 100, 2) AS pct_of_all
              FROM (VALUES ('NULL_CONTENT'), ('COQ_PATH'), ('COQ_MODULE'), ('NON_SYNTH_PATH'),
                           ('NO_MODULE'), ('PREPROCESSING_FAILURE'), ('NO_REASON')) r(reason_code)
              LEFT JOIN flagged f ON f.reason_code = r.reason_code GROUP BY r.reason_code""",
              flagged=FLAGGED),
    ),
    "A4_unbalanced_and_missed": Query(
        _unbalanced,
        check("vcorpus", f"""SELECT (SELECT count(*) FILTER (unbalanced) FROM cleaned) AS n_unbalanced,
              (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ({_LEFT}) a) AS n_leftover""",
              **CLEAN_STAGES),
    ),
    "A5_stage_funnel": Query(
        lambda spark, d: curate.stage_funnel(curate.trace(V.vcorpus(spark, d), min_lines=10)),
        check("vcorpus", FUNNEL, **FUNNEL_STEPS),
    ),
    "A6_variable_totals": Query(
        lambda spark, d: eda.variable_totals(_variables(spark, d)),
        check("varcorpus", "SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_distinct FROM vars",
              vars=VARS),
    ),
    "A7_variable_frequencies": Query(
        lambda spark, d: _variables(spark, d).select("var", "n"),
        check("varcorpus", "SELECT var, n FROM vars", vars=VARS),
    ),
    "A8_rare_variables": Query(
        lambda spark, d: eda.rare(_variables(spark, d)).select("var", "n"),
        check("varcorpus", "SELECT var, n FROM vars WHERE n < 100", vars=VARS),
    ),
    "A9_share_bands": Query(
        lambda spark, d: eda.band_counts(heavy(spark, d)),
        check("varcorpus", "SELECT band, count(*) AS n_rows FROM heavy GROUP BY band", heavy=HEAVY),
    ),
    "A10_rows_per_split": Query(
        lambda spark, d: eda.splits_report(heavy(spark, d), F.col("remove")),
        check("varcorpus", """SELECT coalesce(split, 'all') AS split, count(*) AS n_rows,
                  count(*) FILTER (remove) AS n_removed, count(*) FILTER (NOT remove) AS n_left,
                  round(count(*) FILTER (remove) / count(*) * 100, 6) AS removed_pct
              FROM heavy GROUP BY ROLLUP (split)""", heavy=HEAVY),
    ),
    "A11_word_frequencies": Query(
        _words, check("corpus", "SELECT word, n FROM words", words=WORD_FREQ)
    ),
    "A11_word_totals": Query(
        lambda spark, d: eda.word_totals(_words(spark, d)),
        check("corpus", "SELECT count(*) AS unique_words, CAST(sum(n) AS BIGINT) AS total_words "
              "FROM words", words=WORD_FREQ),
    ),
    "A12_token_count_stats": Query(
        lambda spark, d: eda.token_count_stats(_token_counts(spark, d)),
        check("corpus", f"""SELECT count(*) AS n_docs, round(avg(n), 6) AS mean_token_count,
                  quantile_cont(n, 0.5) AS median_token_count
              FROM (SELECT len(regexp_extract_all(content, '{PRE}')) AS n FROM corpus) t"""),
    ),
    "A12_token_count_histogram": Query(
        lambda spark, d: eda.token_count_histogram(_token_counts(spark, d)).select(
            F.col("n_tokens").cast("bigint").alias("n_tokens"), "n_docs"
        ),
        check("corpus", f"""SELECT n AS n_tokens, count(*) AS n_docs
              FROM (SELECT len(regexp_extract_all(content, '{PRE}')) AS n FROM corpus) t GROUP BY n"""),
    ),
    "A14_distinct_words_by_stage": Query(
        _stages,
        check("vcorpus", f"""SELECT stage, count(DISTINCT word) AS distinct_words FROM (
                  SELECT 'raw' AS stage, unnest({WORDS}) AS word FROM vcorpus
                  UNION ALL SELECT 'cleaned', unnest({WORDS}) FROM cleaned
                  UNION ALL SELECT 'anonymized', unnest({WORDS}) FROM final) w GROUP BY stage""",
              **(CLEAN_STAGES | _ORDER)),
    ),
    "K1_seeded_sample": Query(
        lambda spark, d: split.seeded_sample(_docs(spark, d), 100).select("doc_id", "path"),
        check("corpus", "SELECT doc_id, path FROM corpus ORDER BY sha256('42:' || doc_id), doc_id "
              "LIMIT 100"),
    ),
    "K2_first_rows": Query(
        lambda spark, d: split.first_rows(_docs(spark, d)).select("doc_id", "path"),
        check("corpus", "SELECT doc_id, path FROM corpus ORDER BY doc_id LIMIT 500"),
    ),
    "K3_frequency_extremes": Query(
        lambda spark, d: eda.frequency_extremes(_variables(spark, d)),
        check("varcorpus", """
              (SELECT 'most' AS list, var, n FROM vars ORDER BY n DESC, var LIMIT 10) UNION ALL
              (SELECT 'least', var, n FROM vars ORDER BY n, var DESC LIMIT 100) UNION ALL
              (SELECT 'last_rare', var, n FROM vars WHERE n < 100 ORDER BY seen DESC LIMIT 10)""",
              vars=VARS),
    ),
    "K4_hash_split": Query(
        lambda spark, d: split.assign_split(_docs(spark, d)).select("doc_id", "split"),
        check("corpus", f"SELECT doc_id, split FROM ({SPLIT_SQL}) s"),
    ),
    "K4_exact_split": Query(
        _exact,
        check("corpus", """SELECT doc_id, CASE WHEN r <= ceil(n * 0.1) THEN 'test'
                  WHEN r <= ceil(n * 0.1) + ceil(round((n - ceil(n * 0.1)) * (0.1 / 0.9), 6))
                  THEN 'validation' ELSE 'train' END AS split
              FROM (SELECT doc_id, count(*) OVER () AS n,
                           row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS r
                    FROM corpus) k"""),
    ),
    "K7_epoch_batches": Query(
        lambda spark, d: split.epoch_batches(_docs(spark, d), epoch=1, batch_size=8),
        check("corpus", """SELECT doc_id, r // 8 AS batch_no, r % 8 AS slot, (r // 8) % 8 AS shard
              FROM (SELECT doc_id, row_number() OVER
                        (ORDER BY sha256('42:1:' || doc_id), doc_id) - 1 AS r FROM corpus) k"""),
    ),
}
