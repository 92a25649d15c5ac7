"""Text cleaning: one query per rule, and the whole cleaner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import text as X
from corpusmill.operators import clean
from corpusmill.queries.base import Query, check, listed, quoted, values
from corpusmill.sources import views as V

# --- the same steps in SQL: lists, windows and prefix sums instead of regex folds


def _drop(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, '', 'g')"


LINE_COMMENTS = r"//.*\n"
LEFTOVERS = r"//=*\s*\n?"
BLOCK_COMMENTS = r"(?s)/\*.*?\*/"
ATTRIBUTES = r"(?s)\(\*.*?\*\)"


def _comments(text: str) -> str:
    for pattern in (LINE_COMMENTS, LEFTOVERS, BLOCK_COMMENTS, ATTRIBUTES):
        text = _drop(text, pattern)
    return text


def _endings(text: str) -> str:
    return rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"


def _directives(text: str) -> str:
    return _drop(text, rf"(?m)^\s*(?:{R.any_literal(R.DIRECTIVES)}).*\n")


CODE = f"""
    SELECT doc_id, {_comments(_directives(_endings("coalesce(content, '')")))} AS code FROM vcorpus"""
MASKED = f"""
    SELECT doc_id, code, CASE WHEN len(regexp_extract_all(code, {quoted(R.MODULE_HEADER_REGEX)})) > 1
        THEN {_drop("code", R.MODULE_HEADER_REGEX)} ELSE code END AS masked FROM code"""
FRAGMENTS = f"""
    SELECT doc_id, rule, unnest(regexp_extract_all(masked, pattern)) AS fragment
    FROM masked, {values(R.NON_SYNTHESIZABLE_REGEXES)} r(rule, pattern)"""
STRIPPED = """
    SELECT m.doc_id, CASE WHEN f.found IS NULL THEN m.code
        ELSE list_reduce(f.found, lambda rest, x: replace(rest, x, ''), m.code) END AS code
    FROM masked m LEFT JOIN (
        SELECT doc_id, list(fragment ORDER BY length(fragment) DESC, fragment) AS found
        FROM (SELECT DISTINCT doc_id, fragment FROM fragments) u GROUP BY doc_id) f
    ON m.doc_id = f.doc_id"""


def _lines(source: str, text: str) -> str:
    return rf"""
    SELECT doc_id, line_no, line FROM (
        SELECT doc_id, generate_subscripts(parts, 1) AS line_no,
               regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS line
        FROM (SELECT doc_id, string_split({text}, chr(10)) AS parts FROM {source}) p) l
    WHERE line <> ''"""


STAGES = {
    "code": CODE, "masked": MASKED, "fragments": FRAGMENTS, "stripped": STRIPPED,
    "lines": _lines("stripped", "code"),
}

_KEYWORD_LINE = rf"(?i)^`\s*(?:{R.any_literal(R.VERILOG_KEYWORDS)})\b"
KNOWN_LINE = (
    rf"line = 'begin' OR NOT (starts_with(line, '#') OR regexp_matches(line, '(?i)^`pragma\s') "
    rf"OR (starts_with(line, '`') AND NOT regexp_matches(line, {quoted(_KEYWORD_LINE)})))"
)
INITIAL = r"""
    SELECT doc_id, line_no, line, line <> 'begin' AND (opens OR coalesce(last_value(
        CASE WHEN opens THEN 1 WHEN line = 'end' THEN 0 END IGNORE NULLS) OVER before, 0) = 1) AS dropped
    FROM (SELECT *, regexp_matches(line, '^initial(\s+begin)?$') AS opens FROM {lines}) o
    WINDOW before AS (PARTITION BY doc_id ORDER BY line_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_HAS_END = f"len(list_filter({listed(R.BLOCK_END_MARKERS)}, lambda k: contains(line, k))) > 0"
_HAS_BEGIN = f"len(list_filter({listed(R.BLOCK_BEGIN_MARKERS)}, lambda k: contains(line, k))) > 0"
MARKED = f"""
    SELECT doc_id, line_no, line, line <> 'begin' AND (marker IS NOT NULL OR
        coalesce(last_value(marker IGNORE NULLS) OVER before, 0) = 1) AS dropped
    FROM (SELECT *, CASE WHEN {_HAS_END} THEN 0 WHEN {_HAS_BEGIN} THEN 1 END AS marker
          FROM {{lines}}) m
    WINDOW before AS (PARTITION BY doc_id ORDER BY line_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
HIT = (
    f"list_filter({listed(R.COQ_KEYWORDS)}, lambda k: contains(lower(line), lower(k)))[1]"
)
_SINGLE = R.any_regex(R.SINGLE_LINE_REGEXES)
SINGLE_OK = f"NOT regexp_matches(line, {quoted(_SINGLE)})"
ASSIGN_OK = r"NOT regexp_matches(line, '\b\w+\s*=\s*$')"
COLLAPSE = r"regexp_replace(line, '\s+', ' ', 'g')"


def _kept(source: str, test: str, lines: str = "lines") -> str:
    return f"SELECT doc_id, line_no, line FROM ({source.format(lines=lines)}) d WHERE {test}"


def _text(lines: str, line: str = "line", base: str = "code") -> str:
    return f"""SELECT b.doc_id, coalesce(string_agg({line}, chr(10) ORDER BY line_no), '') AS content
    FROM {base} b LEFT JOIN ({lines}) l ON b.doc_id = l.doc_id GROUP BY b.doc_id"""


_SURVIVING = f"""
    SELECT doc_id, line_no, {COLLAPSE} AS line FROM ({_kept(MARKED, "NOT dropped", "l13")}) x
    WHERE {HIT} IS NULL AND {SINGLE_OK} AND {ASSIGN_OK}"""
_STEPS = r"""
    SELECT *, CASE WHEN regexp_matches(line, '\belse\b')
            AND NOT regexp_matches(line, '\bend\b\s*else\b') AND NOT (begins = 1 AND ends = 1)
            AND NOT coalesce(regexp_matches(lag(line) OVER w, '\bend\s*$'), false)
        THEN 1 ELSE 0 END AS orphan
    FROM (SELECT *, len(regexp_extract_all(line, '\bbegin\b')) AS begins,
                 len(regexp_extract_all(line, '\bend\b')) AS ends FROM surviving) c
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""
# Depth is a walk that never goes below zero: prefix sum minus its running
# minimum, with two steps per line (the inserted end, then begins minus ends).
_WALK = """
    SELECT *, sum(begins - ends - orphan) OVER w AS high,
           sum(begins - ends - orphan) OVER w - (begins - ends) AS low
    FROM steps WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""
_DEPTHS = """
    SELECT doc_id, line_no, line, orphan,
           coalesce(lag(high) OVER w, 0) - least(0, coalesce(min(least(low, high)) OVER (
               PARTITION BY doc_id ORDER BY line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS depth_before,
           high - least(0, min(least(low, high)) OVER (PARTITION BY doc_id ORDER BY line_no))
               AS depth_after,
           row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS from_end
    FROM walk WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""
_CLEANED = """
    SELECT b.doc_id,
           replace(coalesce(string_agg(CASE WHEN orphan = 1 AND depth_before > 0
               THEN 'end' || chr(10) || line ELSE line END, chr(10) ORDER BY line_no), ''),
               '`', '') AS content,
           coalesce(max(depth_after) FILTER (from_end = 1), 0) > 0 AS unbalanced,
           coalesce(max(h.keywords), '') AS coq_keywords,
           coalesce(max(h.keywords), '') <> '' AS coq_flag
    FROM code b LEFT JOIN depths d ON b.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, string_agg(hit, '|' ORDER BY line_no) AS keywords
               FROM hits GROUP BY doc_id) h ON b.doc_id = h.doc_id
    GROUP BY b.doc_id"""
CLEAN_STAGES = STAGES | {
    "l12": f"SELECT * FROM lines WHERE {KNOWN_LINE}",
    "l13": _kept(INITIAL, "NOT dropped", "l12"),
    "hits": f"SELECT doc_id, line_no, {HIT} AS hit FROM l13",
    "surviving": _SURVIVING, "steps": _STEPS, "walk": _WALK, "depths": _DEPTHS,
    "cleaned": _CLEANED,
}

_DIRECTIVE_LINES = rf"""
    SELECT doc_id, unnest(regexp_extract_all({_endings("coalesce(content, '')")},
        '(?m)^\s*((?:{R.any_literal(R.DIRECTIVES)}).*)\n', 1)) AS fragment FROM vcorpus"""
AUDIT_SQL = f"""
    SELECT doc_id, 'directive' AS rule_set, CAST(NULL AS INTEGER) AS rule, fragment FROM ({_DIRECTIVE_LINES}) d
    UNION ALL SELECT doc_id, 'non_synthesizable_regex', rule, fragment FROM fragments
    UNION ALL SELECT doc_id, 'unknown_directive', NULL, line FROM lines WHERE NOT ({KNOWN_LINE})
    UNION ALL SELECT doc_id, 'initial_block', NULL, line FROM ({INITIAL.format(lines="l12")}) i WHERE dropped
    UNION ALL SELECT doc_id, 'marked_block', NULL, line FROM ({MARKED.format(lines="l13")}) m WHERE dropped
    UNION ALL SELECT doc_id, CASE WHEN {HIT} IS NOT NULL THEN 'coq_keyword'
                                  WHEN NOT ({SINGLE_OK}) THEN 'single_line' ELSE 'incomplete_assignment' END, NULL, line
    FROM ({_kept(MARKED, "NOT dropped", "l13")}) x
    WHERE NOT ({HIT} IS NULL AND {SINGLE_OK} AND {ASSIGN_OK})"""

# --- Spark side -----------------------------------------------------------


def _on_content(rule, *columns):
    def build(spark, sf_dir):
        text = V.vcorpus(spark, sf_dir).filter("content IS NOT NULL")
        return text.select("doc_id", rule(F.col("content")).alias("content"))

    return build


def _content_sql(expression: str) -> str:
    return check(
        "vcorpus", f"SELECT doc_id, {expression} AS content FROM vcorpus WHERE content IS NOT NULL"
    )


def _staged(spark, sf_dir):
    return clean.line_text(clean.code_text(V.vcorpus(spark, sf_dir)))


def _unterminated(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\z", "")


def _on_lines(rule):
    def build(spark, sf_dir):
        return _staged(spark, sf_dir).select(
            "doc_id", _unterminated(rule(F.col("code"))).alias("content")
        )

    return build


def _lines_sql(kept: str, line: str = "line") -> str:
    return check("vcorpus", _text(kept, line), **STAGES)


def _masked(spark, sf_dir):
    code = clean.code_text(V.vcorpus(spark, sf_dir))
    return code.select("doc_id", X.mask_module_headers(F.col("code")).alias("content"))


def _fragments(spark, sf_dir):
    found = X.longest_first(F.col("fragments")["fragment"])
    return _staged(spark, sf_dir).select(
        "doc_id", F.size("fragments").cast("bigint").alias("n_matches"),
        F.array_join(found, "|").alias("fragments"),
    )


def _unfragmented(scoped: bool):
    def build(spark, sf_dir):
        code = clean.code_text(V.vcorpus(spark, sf_dir))
        if scoped:
            return code.select("doc_id", X.remove_scoped(F.col("code")).alias("content"))
        code = code.withColumn("masked", X.mask_module_headers(F.col("code")))
        code = code.withColumn("hits", X.matched_fragments(F.col("masked")))
        left = X.remove_fragments(F.col("code"), F.col("hits")["fragment"])
        return code.select("doc_id", left.alias("content"))

    return build


def _scoped_sql() -> str:
    text = "code"
    for pattern in R.NON_SYNTHESIZABLE_REGEXES:
        text = _drop(text, pattern)
    return check("vcorpus", f"SELECT doc_id, {text} AS content FROM code", code=CODE)


def _raw_directive_lines(spark, sf_dir):
    text = X.terminated_lines(F.col("content"))
    return V.vcorpus(spark, sf_dir).filter("content IS NOT NULL").select(
        "doc_id", _unterminated(X.drop_unknown_directives(text)).alias("content")
    )


def _keywords(spark, sf_dir):
    hits = X.literal_hits(F.col("code"))
    return _staged(spark, sf_dir).select(
        "doc_id", F.array_join(hits, "|").alias("coq_keywords"),
        (F.size(hits) > 0).alias("coq_flag"),
    )


def _clean(spark, sf_dir):
    return clean.clean(V.vcorpus(spark, sf_dir))


def _balance(spark, sf_dir):
    return _clean(spark, sf_dir).select("doc_id", "content", "unbalanced")


def _whole(spark, sf_dir):
    return _clean(spark, sf_dir).select(
        "doc_id", "content", F.array_join("coq_keywords", "|").alias("coq_keywords"), "coq_flag",
        "unbalanced",
    )


def _audit(spark, sf_dir):
    return clean.leftover_lines(V.vcorpus(spark, sf_dir)).groupBy("rule", "line").agg(
        F.count(F.lit(1)).alias("n")
    )


_AUDIT_PATTERNS = [R.any_literal([w]) for w in R.COQ_KEYWORDS] + [R.COQ_BINDER_REGEX]
_AUDIT_SQL = f"""
SELECT CAST(rule AS INTEGER) AS rule, line, count(*) AS n
FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM vcorpus) l,
     {values(_AUDIT_PATTERNS)} p(rule, pattern)
WHERE regexp_matches(line, '(?i)' || pattern) GROUP BY ALL"""


def _html(rule):
    def build(spark, sf_dir):
        return V.pages(spark, sf_dir).select("page_id", rule(F.col("html")).alias("html"))

    return build


QUERIES = {
    "T1_line_comments": Query(
        _on_content(X.strip_line_comments), _content_sql(_drop("content", LINE_COMMENTS))
    ),
    "T2_comment_leftovers": Query(
        _on_content(X.strip_comment_leftovers), _content_sql(_drop("content", LEFTOVERS))
    ),
    "T3_block_comments": Query(
        _on_content(X.strip_block_comments), _content_sql(_drop("content", BLOCK_COMMENTS))
    ),
    "T3_html_comments": Query(
        _html(lambda text: X.strip_block_comments(text, "<!--", "-->")),
        f"SELECT page_id, {_drop('html', '(?s)<!--.*?-->')} AS html FROM pages",
    ),
    "T4_attributes": Query(
        _on_content(X.strip_attributes), _content_sql(_drop("content", ATTRIBUTES))
    ),
    "T5_strip_comments": Query(
        lambda spark, d: V.vcorpus(spark, d).select(
            "doc_id", X.strip_comments(F.col("content")).alias("content")
        ),
        check("vcorpus", f"""SELECT doc_id, {_comments("coalesce(content, '')")} AS content
                             FROM vcorpus"""),
    ),
    "T6_line_endings": Query(
        _on_content(X.normalize_line_endings),
        _content_sql("replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))"),
    ),
    "T7_directive_lines": Query(
        _on_content(X.strip_directives), _content_sql(_directives("content"))
    ),
    "T8_mask_module_headers": Query(
        _masked,
        check("vcorpus", "SELECT doc_id, masked AS content FROM masked", code=CODE, masked=MASKED),
    ),
    "T9_fragments": Query(
        _fragments,
        check(
            "vcorpus",
            """SELECT m.doc_id, count(fragment) AS n_matches,
                      coalesce(max(joined), '') AS fragments
               FROM masked m LEFT JOIN fragments f ON m.doc_id = f.doc_id
               LEFT JOIN (SELECT doc_id, string_agg(fragment, '|'
                              ORDER BY length(fragment) DESC, fragment) AS joined
                          FROM (SELECT DISTINCT doc_id, fragment FROM fragments) u
                          GROUP BY doc_id) j ON m.doc_id = j.doc_id
               GROUP BY m.doc_id""",
            code=CODE, masked=MASKED, fragments=FRAGMENTS,
        ),
    ),
    "T10_remove_fragments": Query(
        _unfragmented(scoped=False),
        check("vcorpus", "SELECT doc_id, code AS content FROM stripped", code=CODE, masked=MASKED,
              fragments=FRAGMENTS, stripped=STRIPPED),
    ),
    "T10_remove_scoped": Query(_unfragmented(scoped=True), _scoped_sql()),
    "T11_trim_lines": Query(_on_lines(lambda text: text), _lines_sql("SELECT * FROM lines")),
    "T12_unknown_directives": Query(
        _raw_directive_lines,
        check("vcorpus", _text(f"SELECT * FROM raw WHERE {KNOWN_LINE}", base="present"),
              present="SELECT doc_id, content FROM vcorpus WHERE content IS NOT NULL",
              raw=_lines("present", "content")),
    ),
    "T13_initial_blocks": Query(
        _on_lines(X.drop_initial_blocks), _lines_sql(_kept(INITIAL, "NOT dropped"))
    ),
    "T14_marked_blocks": Query(
        _on_lines(X.drop_marked_blocks), _lines_sql(_kept(MARKED, "NOT dropped"))
    ),
    "T15_coq_keywords": Query(
        _keywords,
        check("vcorpus",
              f"""SELECT b.doc_id, coalesce(string_agg(hit, '|' ORDER BY line_no), '') AS coq_keywords,
                         count(hit) > 0 AS coq_flag
                  FROM code b LEFT JOIN (SELECT doc_id, line_no, {HIT} AS hit FROM lines) h
                  ON b.doc_id = h.doc_id GROUP BY b.doc_id""", **STAGES),
    ),
    "T15_coq_lines": Query(
        _on_lines(X.drop_literal_lines), _lines_sql(f"SELECT * FROM lines WHERE {HIT} IS NULL")
    ),
    "T16_single_lines": Query(
        _on_lines(X.drop_single_lines), _lines_sql(f"SELECT * FROM lines WHERE {SINGLE_OK}")
    ),
    "T17_dangling_assignments": Query(
        _on_lines(X.drop_dangling_assignments), _lines_sql(f"SELECT * FROM lines WHERE {ASSIGN_OK}")
    ),
    "T18_whitespace": Query(
        _on_lines(X.collapse_spaces), _lines_sql("SELECT * FROM lines", COLLAPSE)
    ),
    "T18_page_whitespace": Query(
        _html(X.collapse_whitespace),
        check("", f"""SELECT page_id, coalesce(string_agg({COLLAPSE}, chr(10) ORDER BY line_no), '')
                             AS html
                      FROM lines GROUP BY page_id""",
              lines=_lines("pages", "html").replace("doc_id", "page_id")),
    ),
    "T19_balance_blocks": Query(
        _balance,
        check("vcorpus", "SELECT doc_id, content, unbalanced FROM cleaned", **CLEAN_STAGES),
    ),
    "T20_rejoin": Query(
        lambda spark, d: _clean(spark, d).select(
            "doc_id", F.length("content").cast("bigint").alias("n_chars"),
            F.octet_length("content").cast("bigint").alias("n_bytes"),
        ),
        check("vcorpus", "SELECT doc_id, length(content) AS n_chars, strlen(content) AS n_bytes "
              "FROM cleaned", **CLEAN_STAGES),
    ),
    "T21_clean_document": Query(
        _whole,
        check("vcorpus", "SELECT doc_id, content, coq_keywords, coq_flag, unbalanced FROM cleaned",
              **CLEAN_STAGES),
    ),
    "T22_leftover_audit": Query(_audit, check("vcorpus", _AUDIT_SQL)),
    "W2_block_states": Query(
        lambda spark, d: clean.block_states(_staged(spark, d)),
        check("vcorpus", f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id
                  ORDER BY line_no) - 1 AS INTEGER) AS line_no, line, dropped
              FROM ({MARKED.format(lines="lines")}) s""", **STAGES),
    ),
}
