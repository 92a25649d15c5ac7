"""The cleaning job: one narrow chain of per-document expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import text as X
from corpusmill.functions.staging import evaluate_once


def code_text(df: DataFrame, content: str = "content", keep_conditional: bool = False) -> DataFrame:
    """Line endings, directives and comments out of the way: column ``code``."""
    text = X.normalize_line_endings(F.coalesce(F.col(content), F.lit("")))
    text = X.strip_directives(text, keep_conditional=keep_conditional)
    return df.withColumn("code", X.strip_comments(text))


def line_text(df: DataFrame) -> DataFrame:
    """Column ``code`` without fragments, as trimmed LF-terminated lines."""
    df = df.withColumn("masked", X.mask_module_headers(F.col("code")))
    df = df.withColumn("fragments", X.matched_fragments(F.col("masked"))).drop("masked")
    stripped = X.remove_fragments(F.col("code"), F.col("fragments")["fragment"])
    return df.withColumn("code", X.terminated_lines(stripped))


def scan_keywords(
    df: DataFrame, until_eof: bool = False, keep_conditional: bool = False,
    word_boundary: bool = False,
) -> DataFrame:
    """The first half of cleaning: ``code``, ``coq_keywords`` and ``coq_flag``.

    The keyword scan runs before marked blocks are dropped, so a block that
    hides such a line still flags its file.
    """
    c = F.col
    df = line_text(code_text(df, keep_conditional=keep_conditional)).drop("fragments")
    df = df.withColumn("code", X.drop_unknown_directives(c("code")))
    df = df.withColumn("code", X.drop_initial_blocks(c("code"), until_eof))
    df = df.withColumn("coq_keywords", X.literal_hits(c("code"), word_boundary=word_boundary))
    return df.withColumn("coq_flag", F.size("coq_keywords") > 0)


def clean(
    df: DataFrame, until_eof: bool = False, keep_conditional: bool = False,
    word_boundary: bool = False,
) -> DataFrame:
    """Clean ``content``; add ``coq_keywords``, ``coq_flag``, ``unbalanced``."""
    c = F.col
    kept = [name for name in df.columns if name not in ("coq_flag", "coq_keywords")]
    df = scan_keywords(df, until_eof, keep_conditional, word_boundary)
    df = df.withColumn("code", X.drop_marked_blocks(c("code")))
    df = df.withColumn(
        "code", F.when(c("coq_flag"), X.drop_literal_lines(c("code"))).otherwise(c("code"))
    )
    df = df.withColumn("code", X.drop_single_lines(c("code")))
    df = df.withColumn("code", X.drop_dangling_assignments(c("code")))
    df = df.withColumn("lines", X.lines_of(X.collapse_spaces(c("code"))))
    df = evaluate_once(df.withColumn("balance", X.balance_blocks(c("lines"))), "balance")
    df = df.withColumn("unbalanced", c("balance")["depth"] > 0)
    joined = F.array_join(X.insert_ends(c("lines"), c("balance")["closes"]), "\n")
    df = df.withColumn("content", X.strip_backticks(joined))
    df = df.select(*kept, "coq_keywords", "coq_flag", "unbalanced")
    return evaluate_once(df, "content", "coq_keywords", "coq_flag", "unbalanced")


def fragment_log(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Audit rows ``(key, rule_set, rule, fragment)`` of every removal by rule."""
    df = code_text(df).withColumn("masked", X.mask_module_headers(F.col("code")))
    found = df.select(key, X.matched_fragments(F.col("masked")).alias("hits"))
    return evaluate_once(found, "hits").select(key, F.inline("hits")).select(
        key, F.lit("non_synthesizable_regex").alias("rule_set"), "rule", "fragment"
    )


def audit_log(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Audit rows ``(key, rule_set, rule, fragment)`` of everything that cleaning removes.

    Rule sets, in the order of the steps: directive, non_synthesizable_regex
    (with the number of the rule, else null), unknown_directive, initial_block,
    marked_block, coq_keyword, single_line and incomplete_assignment. Each
    step looks at what the steps before it left.
    """
    c = F.col
    text = X.normalize_line_endings(F.coalesce("content", F.lit("")))
    found = {"directive": X.find_all(text, X.directive_line(), 1)}
    rows = df.select(key, found["directive"].alias("directive"), "content")
    rows = line_text(code_text(rows)).select(key, "directive", "fragments", c("code").alias("l0"))
    rows = rows.withColumn("unknown_directive", X.found_lines(c("l0"), X.unknown_directive()))
    rows = rows.withColumn("l1", X.drop_unknown_directives(c("l0")))
    rows = rows.withColumn("initial_block", X.block_lines(c("l1"), X.initial_block()))
    rows = rows.withColumn("l2", X.drop_initial_blocks(c("l1")))
    rows = rows.withColumn("marked_block", X.marked_lines(c("l2")))
    rows = rows.withColumn("l3", X.drop_marked_blocks(c("l2")))
    rows = rows.withColumn("coq_keyword", X.found_lines(c("l3"), X.line_with(R.any_literal(R.COQ_KEYWORDS), "i")))
    rows = rows.withColumn("l4", X.drop_literal_lines(c("l3")))
    rows = rows.withColumn("single_line", X.found_lines(c("l4"), X.line_with(R.any_regex(R.SINGLE_LINE_REGEXES))))
    rows = rows.withColumn("l5", X.drop_single_lines(c("l4")))
    rows = rows.withColumn("incomplete_assignment", X.found_lines(c("l5"), X.DANGLING_LINE))
    line_sets = (
        "directive", "unknown_directive", "initial_block", "marked_block", "coq_keyword",
        "single_line", "incomplete_assignment",
    )

    def tagged(name: str):
        return F.transform(c(name), lambda line: F.struct(
            F.lit(name).alias("rule_set"), F.lit(None).cast("int").alias("rule"), line.alias("fragment")
        ))

    by_rule = F.transform("fragments", lambda hit: F.struct(
        F.lit("non_synthesizable_regex").alias("rule_set"), hit["rule"].alias("rule"),
        hit["fragment"].alias("fragment"),
    ))
    return rows.select(key, F.inline(F.concat(by_rule, *map(tagged, line_sets))))


def code_lines(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form ``(key, line_no, line)`` of LF-terminated ``code``."""
    return df.select(key, F.posexplode(X.lines_of(F.col("code"))).alias("line_no", "line"))


def block_states(
    df: DataFrame, begin=R.BLOCK_BEGIN_MARKERS, end=R.BLOCK_END_MARKERS, key: str = "doc_id"
) -> DataFrame:
    """The line-level audit of marked blocks: which lines a block swallows.

    One partition of the window is one document, so no group outgrows a file.
    """
    marker = F.when(F.col("line").rlike(R.any_literal(end)), 0).when(
        F.col("line").rlike(R.any_literal(begin)), 1
    )
    lines = code_lines(df, key).withColumn("marker", marker)
    earlier = Window.partitionBy(key).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    state = F.coalesce(F.last("marker", ignorenulls=True).over(earlier), F.lit(0))
    dropped = (F.col("marker").isNotNull() | (state == 1)) & (F.col("line") != "begin")
    return lines.select(key, "line_no", "line", dropped.alias("dropped"))


def leftover_lines(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of the cleaned content that still match a literal or the binder."""
    return df.select(key, F.inline(X.leftover_hits(F.col("content"))))
