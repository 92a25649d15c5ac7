"""Flags, predicates and filters over rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import text as X
from corpusmill.operators import clean, evaluate, flags
from corpusmill.plans import curate
from corpusmill.queries.base import Query, check, listed, quoted
from corpusmill.queries.cleaning import CLEAN_STAGES, CODE, _comments
from corpusmill.sources import views as V

# The cascade in SQL: comments first, then the first reason that applies.
FLAGGED = f"""
    SELECT *, CASE
        WHEN raw IS NULL THEN 'NULL_CONTENT'
        WHEN contains(full_path, 'coq') THEN 'COQ_PATH'
        WHEN header <> '' THEN 'COQ_MODULE'
        WHEN word IS NOT NULL THEN 'NON_SYNTH_PATH'
        WHEN NOT regexp_matches(content, {quoted(R.MODULE_HEADER_REGEX)}) THEN 'NO_MODULE'
        END AS reason_code
    FROM (SELECT *, regexp_extract(content, {quoted(R.COQ_MODULE_REGEX)}) AS header,
                 list_filter({listed(R.PATH_KEYWORDS)}, lambda k: contains(full_path, k))[1] AS word
          FROM (SELECT doc_id, path, size, content AS raw,
                       {_comments("coalesce(content, '')")} AS content,
                       lower(repo_name || '/' || path) AS full_path FROM vcorpus) p) q"""
DETAIL = """CASE reason_code WHEN 'COQ_PATH' THEN 'coq' WHEN 'COQ_MODULE' THEN header
    WHEN 'NON_SYNTH_PATH' THEN word WHEN 'NULL_CONTENT' THEN '' WHEN 'NO_MODULE' THEN '' END"""
COQ = "coalesce(reason_code IN ('COQ_PATH', 'COQ_MODULE'), false)"

_FLAGS = ("doc_id", "reason_code", "reason_detail", "remove_flag", "coq_flag")


def flagged(spark, sf_dir):
    return flags.flag(V.vcorpus(spark, sf_dir))


def judged(spark, sf_dir):
    """All flags: the Coq flag of the text joins that of the path."""
    return curate.judge_flags(V.vcorpus(spark, sf_dir))


JUDGED = f"""
    SELECT f.doc_id, f.path, f.size, f.reason_code, f.reason_code IS NOT NULL AS remove_flag,
           CASE WHEN f.reason_code IS NOT NULL THEN {COQ} ELSE c.coq_flag END AS coq_flag
    FROM flagged f JOIN cleaned c ON f.doc_id = c.doc_id"""
JUDGED_STAGES = {"flagged": FLAGGED} | CLEAN_STAGES | {"judged": JUDGED}


def _on_paths(column):
    return lambda spark, d: V.vcorpus(spark, d).select("doc_id", column())


def _code(spark, sf_dir):
    return clean.code_text(V.vcorpus(spark, sf_dir))


def heavy(spark, sf_dir):
    return flags.flag_identifier_heavy(V.varcorpus(spark, sf_dir))


HEAVY = r"""
    SELECT *, share IS NULL OR share > 0.49 OR big_variable AS remove,
           CASE WHEN share IS NULL THEN 'empty' WHEN share > 0.9 THEN '>0.9'
                WHEN share > 0.8 THEN '>0.8' WHEN share > 0.7 THEN '>0.7'
                WHEN share > 0.6 THEN '>0.6' WHEN share > 0.49 THEN '>0.49' ELSE 'kept' END AS band
    FROM (SELECT *, CASE WHEN content <> '' THEN
                 coalesce(list_sum(list_transform(vars, lambda v: length(v))), 0) / length(content)
                 END AS share,
                 regexp_matches(content, '\bVAR1[0-9]{2,}\b') AS big_variable
          FROM (SELECT *, regexp_extract_all(content, '\bVAR[0-9]+\b') AS vars FROM varcorpus) v) s"""


def _ignoring(spark, sf_dir):
    rows = V.predictions(spark, sf_dir)
    label = F.when(F.col("pos") % 7 == 0, evaluate.IGNORE_LABEL).otherwise(F.col("label"))
    scored = evaluate.score_rows(rows.withColumn("label", label.cast("int")))
    return scored.filter("counted").select("pos", "label", "pred")


LABEL_VOCAB = """SELECT DISTINCT label AS id, CASE label % 4 WHEN 0 THEN 'VAR' || label
    WHEN 1 THEN 'MODULE' || label WHEN 2 THEN 'SUBMODULE' || label
    ELSE 'word' || label END AS token FROM embeddings"""


def label_vocab(spark, sf_dir):
    """A vocabulary for the label ids in which some tokens are placeholders."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return spark.sql(
        LABEL_VOCAB.replace("DISTINCT label AS id", "DISTINCT cast(label AS int) AS id").replace(
            "FROM embeddings", "FROM {source}"
        ),
        source=embeddings,
    )


def _masked(spark, sf_dir):
    scored = evaluate.score_rows(V.predictions(spark, sf_dir))
    return evaluate.mask_flag(scored, label_vocab(spark, sf_dir)).select("pos", "label", "masked")


def _reserved(spark, sf_dir):
    words = spark.createDataFrame(
        [(w,) for w in R.reserved_identifiers()], "identifier string"
    )
    found = _code(spark, sf_dir).select(
        F.explode(X.find_all(F.col("code"), r"[A-Za-z_][A-Za-z0-9_]*")).alias("identifier")
    )
    counted = found.groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(words), "identifier", "left_anti")  # fixed-size list


def _flags_left(spark, sf_dir):
    """What the check of the filter counts."""
    return flags.flags_left(flags.keep_valid(judged(spark, sf_dir)))


def _removed_paths(spark, sf_dir):
    return heavy(spark, sf_dir).filter("remove").select("doc_id", "path", "split")


QUERIES = {
    "F1_drop_null_content": Query(
        lambda spark, d: flags.drop_null_content(V.vcorpus(spark, d)).select("doc_id", "path"),
        check("vcorpus", "SELECT doc_id, path FROM vcorpus WHERE content IS NOT NULL"),
    ),
    "F1_null_content_count": Query(
        lambda spark, d: flags.null_content_count(V.vcorpus(spark, d)),
        check("vcorpus", "SELECT count(*) AS n_rows, count(*) - count(content) AS n_null, "
              "count(content) AS n_kept FROM vcorpus"),
    ),
    "F2_null_content_flag": Query(
        lambda spark, d: V.vcorpus(spark, d).select(
            "doc_id", F.col("content").isNull().alias("is_null"),
            F.length(F.coalesce("content", F.lit(""))).cast("bigint").alias("n_chars"),
        ),
        check("vcorpus", "SELECT doc_id, content IS NULL AS is_null, "
              "length(coalesce(content, '')) AS n_chars FROM vcorpus"),
    ),
    "F3_full_path": Query(
        _on_paths(lambda: flags.full_path().alias("full_path")),
        check("vcorpus", "SELECT doc_id, lower(repo_name || '/' || path) AS full_path FROM vcorpus"),
    ),
    "F4_coq_path": Query(
        _on_paths(lambda: flags.has_coq_path().alias("coq_path")),
        check("vcorpus", "SELECT doc_id, (repo_name || '/' || path) ILIKE '%coq%' AS coq_path "
              "FROM vcorpus"),
    ),
    "F4_coq_url": Query(
        lambda spark, d: V.pages(spark, d).select(
            "page_id", flags.has_coq(F.lower("url")).alias("hit")
        ),
        "SELECT page_id, url ILIKE '%coq%' AS hit FROM pages",
    ),
    "F5_coq_module_header": Query(
        lambda spark, d: _code(spark, d).select(
            "doc_id", flags.coq_module_header(F.col("code")).alias("header")
        ),
        check("vcorpus", f"SELECT doc_id, regexp_extract(code, {quoted(R.COQ_MODULE_REGEX)}) "
              "AS header FROM code", code=CODE),
    ),
    "F6_path_keyword": Query(
        _on_paths(
            lambda: F.coalesce(flags.first_contained(flags.full_path(), R.PATH_KEYWORDS), F.lit("")).alias("word")
        ),
        check("vcorpus", f"""SELECT doc_id, coalesce(list_filter({listed(R.PATH_KEYWORDS)},
              lambda k: contains(lower(repo_name || '/' || path), k))[1], '') AS word FROM vcorpus"""),
    ),
    "F6_url_keyword": Query(
        lambda spark, d: V.pages(spark, d).select(
            "page_id",
            F.coalesce(
                flags.first_contained(F.lower("url"), ("/de/", "/en/", "ref", "page")), F.lit("")
            ).alias("word"),
        ),
        "SELECT page_id, coalesce(list_filter(['/de/', '/en/', 'ref', 'page'], "
        "lambda k: contains(lower(url), k))[1], '') AS word FROM pages",
    ),
    "F7_no_module": Query(
        lambda spark, d: _code(spark, d).select(
            "doc_id", (~flags.has_module(F.col("code"))).alias("no_module")
        ),
        check("vcorpus", f"SELECT doc_id, NOT regexp_matches(code, {quoted(R.MODULE_HEADER_REGEX)}) "
              "AS no_module FROM code", code=CODE),
    ),
    "F8_reason_cascade": Query(
        lambda spark, d: flagged(spark, d).select(*_FLAGS),
        check("vcorpus", f"""SELECT doc_id, reason_code, {DETAIL} AS reason_detail,
              reason_code IS NOT NULL AS remove_flag, {COQ} AS coq_flag FROM flagged""",
              flagged=FLAGGED),
    ),
    "F9_keep_valid": Query(
        lambda spark, d: flags.keep_valid(judged(spark, d)).select("doc_id", "path"),
        check("vcorpus", "SELECT doc_id, path FROM judged WHERE NOT remove_flag AND NOT coq_flag",
              **JUDGED_STAGES),
    ),
    "F10_removed": Query(
        lambda spark, d: flags.removed(flagged(spark, d)).select("doc_id", "reason_code"),
        check("vcorpus", "SELECT doc_id, reason_code FROM judged WHERE remove_flag",
              **JUDGED_STAGES),
    ),
    "F10_coq_suspects": Query(
        lambda spark, d: flags.coq_suspects(judged(spark, d)).select("doc_id", "path"),
        check("vcorpus", "SELECT doc_id, path FROM judged WHERE coq_flag AND NOT remove_flag",
              **JUDGED_STAGES),
    ),
    "F11_flags_left": Query(
        _flags_left,
        check("vcorpus", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_flagged FROM judged "
              "WHERE NOT remove_flag AND NOT coq_flag", **JUDGED_STAGES),
    ),
    "F12_stage_columns": Query(
        lambda spark, d: flagged(spark, d)
        .drop("content", "remove_flag", "coq_flag", "reason_detail")
        .withColumnRenamed("reason_code", "remove_reason")
        .select("repo_name", "path", "size", "license", "remove_reason"),
        check("vcorpus", "SELECT v.repo_name, v.path, v.size, v.license, f.reason_code AS "
              "remove_reason FROM vcorpus v JOIN flagged f ON v.doc_id = f.doc_id",
              flagged=FLAGGED),
    ),
    "F13_drop_short_files": Query(
        lambda spark, d: flags.keep_long(V.corpus(spark, d), 6).select(
            "doc_id", flags.line_count(F.col("content")).cast("bigint").alias("n_lines")
        ),
        check("corpus", "SELECT doc_id, len(string_split(content, chr(10))) AS n_lines FROM corpus "
              "WHERE len(string_split(content, chr(10))) >= 6"),
    ),
    "F14_short_file_sweep": Query(
        lambda spark, d: flags.short_file_sweep(V.corpus(spark, d)),
        check("corpus", """SELECT CAST(t AS BIGINT) AS min_lines, count(*) FILTER (n >= t) AS rows_kept,
              CAST(coalesce(sum(size) FILTER (n >= t), 0) AS BIGINT) AS bytes_kept,
              round(100 * (1 - count(*) FILTER (n >= t) / count(*)), 6) AS rows_cut_pct
              FROM (SELECT size, len(string_split(content, chr(10))) AS n FROM corpus) c,
                   (VALUES (6), (20), (30), (50)) v(t) GROUP BY t"""),
    ),
    "F15_empty_content": Query(
        lambda spark, d: V.varcorpus(spark, d).select(
            "doc_id", (F.coalesce("content", F.lit("")) == "").alias("empty")
        ),
        check("varcorpus", "SELECT doc_id, coalesce(content, '') = '' AS empty FROM varcorpus"),
    ),
    "F16_variable_share": Query(
        lambda spark, d: heavy(spark, d).select(
            "doc_id", F.round("share", 6).alias("share"), "band"
        ),
        check("varcorpus", "SELECT doc_id, round(share, 6) AS share, band FROM heavy", heavy=HEAVY),
    ),
    "F17_big_variables": Query(
        lambda spark, d: heavy(spark, d).select("doc_id", "big_variable"),
        check("varcorpus", "SELECT doc_id, big_variable FROM heavy", heavy=HEAVY),
    ),
    "F17_distinct_variables": Query(
        lambda spark, d: flags.flag_identifier_heavy(V.varcorpus(spark, d), min_distinct=100).select(
            "doc_id", "big_variable"
        ),
        check("varcorpus", "SELECT doc_id, len(list_distinct(vars)) >= 100 AS big_variable FROM heavy",
              heavy=HEAVY),
    ),
    "F18_removed_paths": Query(
        _removed_paths,
        check("varcorpus", "SELECT doc_id, path, split FROM heavy WHERE remove", heavy=HEAVY),
    ),
    "F18_remaining": Query(
        lambda spark, d: heavy(spark, d).filter("NOT remove").select("doc_id", "content"),
        check("varcorpus", "SELECT doc_id, content FROM heavy WHERE NOT remove", heavy=HEAVY),
    ),
    "F19_masked_labels": Query(
        _masked,
        check("predictions", r"""SELECT p.pos, p.label,
              regexp_matches(v.token, '^(VAR|MODULE|SUBMODULE)\d+') AS masked
              FROM predictions p JOIN vocab v ON p.label = v.id""", vocab=LABEL_VOCAB),
    ),
    "F20_ignored_labels": Query(
        _ignoring,
        check("predictions", """SELECT pos, label, CAST(list_position(logits, list_max(logits)) - 1
              AS INTEGER) AS pred FROM predictions WHERE pos % 7 <> 0"""),
    ),
    "F21_not_reserved": Query(
        _reserved,
        check("vcorpus", f"""SELECT identifier, count(*) AS n FROM (SELECT unnest(
              regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) AS identifier FROM code) i
              WHERE NOT list_contains({listed(R.reserved_identifiers())}, identifier)
              GROUP BY identifier""", code=CODE),
    ),
}
