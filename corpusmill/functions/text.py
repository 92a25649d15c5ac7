"""Text cleaning as column expressions: ``content -> content``.

Each function is a narrow, per-row expression on the JVM, so a whole cleaning
run is one stage without a shuffle. ``(?d)`` keeps ``.``/``^``/``$`` bound to
LF. Line rules run on text whose every line ends in LF (``terminated_lines``),
which lets a rule drop a line with one linear ``regexp_replace``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import rules as R

# White space as Unicode defines it, not just the ASCII part.
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_BLANK = rf"[{_SPACE}&&[^\n]]"

STRINGS = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(STRINGS)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def literals(items) -> Column:
    """A constant array of strings, built in one call."""
    quoted = (item.replace("\\", "\\\\").replace("'", "\\'") for item in dict.fromkeys(items))
    return F.expr("array(" + ", ".join(f"'{item}'" for item in quoted) + ")")


def contains_any(text: Column, words) -> Column:
    """Plain substring tests, far cheaper than the regular expressions they guard.

    A word that contains another one of the list adds nothing.
    """
    unique = list(dict.fromkeys(words))
    needed = [w for w in unique if not any(o != w and o in w for o in unique)]
    return F.exists(literals(needed), lambda word: F.contains(text, word))


def contains_any_case(text: Column, words) -> Column:
    """The same without regard to case; the text is lowered once."""
    lowered = [word.lower() for word in words]
    return F.exists(F.array(F.lower(text)), lambda low: contains_any(low, lowered))


# --- comments, line endings, directives -----------------------------------


def strip_line_comments(text: Column) -> Column:
    """``// ...`` up to and including the line feed; the next line joins."""
    return F.regexp_replace(text, r"(?d)//.*\n", "")


def strip_comment_leftovers(text: Column) -> Column:
    """A ``//`` that no line feed follows loses its slashes, not its text."""
    return F.regexp_replace(text, r"//=*\s*\n?", "")


def strip_block_comments(text: Column, opening: str = r"/\*", closing: str = r"\*/") -> Column:
    return F.regexp_replace(text, rf"(?s){opening}.*?{closing}", "")


def strip_attributes(text: Column) -> Column:
    return strip_block_comments(text, r"\(\*", r"\*\)")


def strip_comments(text: Column) -> Column:
    """All comment forms in order; null becomes the empty text."""
    text = F.coalesce(text, F.lit(""))
    text = strip_comment_leftovers(strip_line_comments(text))
    return strip_attributes(strip_block_comments(text))


def normalize_line_endings(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_directives(
    text: Column, directives=R.DIRECTIVES, keep_conditional: bool = False
) -> Column:
    """Lines that start with a directive, with the blank lines above them."""
    if keep_conditional:
        directives = [d for d in directives if d not in R.CONDITIONAL_DIRECTIVES]
    return F.regexp_replace(text, directive_line(directives), "")


def directive_line(directives=R.DIRECTIVES) -> str:
    """Pattern of such a line; group 1 is the line without what stands before it."""
    return rf"(?md)^\s*((?:{R.any_literal(directives)}).*)\n"


# --- fragments ------------------------------------------------------------


def _closed_and_rest(text: Column) -> tuple[Column, Column]:
    """The text up to its last semicolon, and what follows."""
    rest = F.substring_index(text, ";", -1)
    return F.substring(text, 1, F.length(text) - F.length(rest)), rest


def has_module_header(text: Column) -> Column:
    """Whether a module header is closed by a semicolon; linear, as no open header is searched to the end."""
    return _closed_and_rest(text)[0].rlike(R.MODULE_START_REGEX)


def mask_module_headers(text: Column) -> Column:
    """Hide module headers from the fragment scan when there are several."""
    closed, rest = _closed_and_rest(text)
    many = F.regexp_count(closed, F.lit(R.MODULE_HEADER_REGEX)) > 1
    return F.when(many, F.concat(F.regexp_replace(closed, R.MODULE_HEADER_REGEX, ""), rest)).otherwise(text)


def matched_fragments(
    text: Column, patterns=R.NON_SYNTHESIZABLE_REGEXES, guards=R.FRAGMENT_GUARDS
) -> Column:
    """Every match of every rule as ``array<struct<rule:int, fragment:string>>``.

    ``guards`` names, for some patterns, a text that all their matches hold:
    rules with one guard are skipped together where it is missing. A pattern
    without a guard is always searched for.
    """
    groups: dict[str | None, list[int]] = {}
    for rule, pattern in enumerate(patterns):
        groups.setdefault(guards.get(pattern), []).append(rule)
    found = []
    for literal, rules in groups.items():
        hits = F.array(*(find_all(text, f"(?d){patterns[rule]}") for rule in rules))
        none = F.array_repeat(empty_strings(), len(rules))
        guarded = F.when(F.contains(text, F.lit(literal)), hits).otherwise(none)
        found.append(hits if literal is None else guarded)
    order = ", ".join(str(rule) for rules in groups.values() for rule in rules)
    numbers = F.expr(f"array({order})")
    tagged = F.transform(
        F.flatten(F.array(*found)),
        lambda hits, i: F.transform(
            hits,
            lambda hit: F.struct(F.get(numbers, i).alias("rule"), hit.alias("fragment")),
        ),
    )
    return F.flatten(tagged)


def longest_first(fragments: Column) -> Column:
    keyed = F.transform(
        F.array_distinct(fragments),
        lambda f: F.struct((-F.length(f)).alias("n"), f.alias("fragment")),
    )
    return F.sort_array(keyed)["fragment"]


def remove_fragments(text: Column, fragments: Column) -> Column:
    """Remove each distinct fragment wherever it stands, longest first."""
    return F.aggregate(
        longest_first(fragments), text, lambda left, f: F.replace(left, f, F.lit(""))
    )


def remove_scoped(text: Column, patterns=R.NON_SYNTHESIZABLE_REGEXES) -> Column:
    """The narrower mode: each rule removes only what it matches itself."""
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?d){pattern}", "")
    return text


# --- lines ----------------------------------------------------------------


def trim_lines(text: Column) -> Column:
    """Trim every line and drop the empty ones."""
    text = F.regexp_replace(text, rf"(?<!{_BLANK}){_BLANK}*\n[{_SPACE}]*", "\n")
    return F.regexp_replace(text, rf"\A[{_SPACE}]+|(?<![{_SPACE}])[{_SPACE}]+\z", "")


def terminated_lines(text: Column) -> Column:
    """Trimmed text in which every line, the last too, ends in LF."""
    return F.regexp_replace(F.concat(trim_lines(text), F.lit("\n")), r"\A\n\z", "")


def lines_of(text: Column) -> Column:
    """The lines of LF-terminated text."""
    return F.array_remove(F.split(text, "\n"), "")


def line_with(pattern: str, flags: str = "") -> str:
    """Pattern of a line that ``pattern`` matches somewhere."""
    return rf"(?md{flags})^.*(?:{pattern}).*\n"


def drop_lines(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_replace(text, line_with(pattern, flags), "")


def found_lines(text: Column, pattern: str) -> Column:
    """The lines, without LF, that a line pattern matches."""
    return F.transform(find_all(text, pattern), lambda line: F.rtrim(line, F.lit("\n")))


def unknown_directive(keywords=R.VERILOG_KEYWORDS) -> str:
    gap = r"[^\S\n]"
    known = rf"(?!{gap}*(?:{R.any_literal(keywords)})\b)"
    return rf"(?mdi)^(?:#|`pragma{gap}|`{known}).*\n"


def drop_unknown_directives(text: Column, keywords=R.VERILOG_KEYWORDS) -> Column:
    """Backtick lines that name no keyword, pragma lines and ``#`` lines."""
    return F.regexp_replace(text, unknown_directive(keywords), "")


def _drop_blocks(text: Column, block: str) -> Column:
    """Remove blocks of lines; lone ``begin`` lines inside them stay."""
    pieces = F.arrays_zip(
        F.split(text, block, -1).alias("outside"), find_all(text, block).alias("inside")
    )
    kept = F.transform(
        pieces,
        lambda piece: F.concat(
            piece["outside"],
            F.array_join(
                find_all(F.coalesce(piece["inside"], F.lit("")), r"(?md)^begin\n"), ""
            ),
        ),
    )
    return F.array_join(kept, "")


def block_lines(text: Column, block: str) -> Column:
    """The lines that ``_drop_blocks`` removes."""
    return F.flatten(F.transform(
        find_all(text, block),
        lambda piece: F.filter(F.split(piece, "\n"), lambda line: (line != "") & (line != "begin")),
    ))


_INITIAL_LINE = r"initial(?:[^\S\n]+begin)?\n"


def initial_block(until_eof: bool = False) -> str:
    body = r"(?:.*\n)*+" if until_eof else r"(?:(?!end\n).*\n)*+(?:end\n)?"
    return rf"(?md)^{_INITIAL_LINE}{body}"


def drop_initial_blocks(text: Column, until_eof: bool = False) -> Column:
    """From a bare ``initial`` line to the next lone ``end`` line."""
    block = initial_block(until_eof)
    return F.when(F.contains(text, F.lit("initial")), _drop_blocks(text, block)).otherwise(text)


def marked_block(begin=R.BLOCK_BEGIN_MARKERS, end=R.BLOCK_END_MARKERS) -> str:
    opens, closes = R.any_literal(begin), R.any_literal(end)
    return (
        rf"(?md)^(?!.*(?:{closes}))(?=.*(?:{opens})).*\n"
        rf"(?:(?!.*(?:{closes})).*\n)*+(?:.*\n)?"
    )


def marked_lines(text: Column, begin=R.BLOCK_BEGIN_MARKERS, end=R.BLOCK_END_MARKERS) -> Column:
    """The lines that ``drop_marked_blocks`` removes: of blocks, then stray end markers."""
    block = marked_block(begin, end)
    strays = found_lines(_drop_blocks(text, block), line_with(R.any_literal(end)))
    found = F.concat(block_lines(text, block), strays)
    return F.when(contains_any(text, (*begin, *end)), found).otherwise(empty_strings())


def drop_marked_blocks(
    text: Column, begin=R.BLOCK_BEGIN_MARKERS, end=R.BLOCK_END_MARKERS
) -> Column:
    """From a begin marker line to an end marker line, both included.

    An end marker wins over a begin marker on the same line; a block without
    an end runs to the end of the text; stray end marker lines go too.
    """
    cleaned = drop_lines(_drop_blocks(text, marked_block(begin, end)), R.any_literal(end))
    return F.when(contains_any(text, (*begin, *end)), cleaned).otherwise(text)


def literal_hits(text: Column, words=R.COQ_KEYWORDS, word_boundary: bool = False) -> Column:
    """Per line that contains a word of the list, the first such word."""

    def found(line: Column, word: str) -> Column:
        if word_boundary:
            return line.rlike(rf"(?i)(?<!\w)\Q{word}\E(?!\w)")
        return F.contains(line, F.lit(word.lower()))

    def first_hit(line: Column) -> Column:
        return F.coalesce(*(F.when(found(line, word), F.lit(word)) for word in words))

    # the text is lower-cased once, not each line once per word
    first = F.transform(lines_of(text if word_boundary else F.lower(text)), first_hit)
    return F.when(contains_any_case(text, words), F.array_compact(first)).otherwise(
        empty_strings()
    )


def drop_literal_lines(text: Column, words=R.COQ_KEYWORDS) -> Column:
    dropped = drop_lines(text, R.any_literal(words), "i")
    return F.when(contains_any_case(text, words), dropped).otherwise(text)


def drop_single_lines(text: Column, patterns=R.SINGLE_LINE_REGEXES) -> Column:
    """Lines that match one of the regular expressions anywhere.

    Patterns that are plain words but for word boundaries get a cheap guard.
    """
    dropped = drop_lines(text, R.any_regex(patterns))
    plain = [pattern.replace(r"\b", "") for pattern in patterns]
    if all(re.fullmatch(r"[\w #]+", word) for word in plain):
        return F.when(contains_any(text, plain), dropped).otherwise(text)
    return dropped


DANGLING_LINE = r"(?md)^.*\w[^\S\n]*=[^\S\n]*\n"


def drop_dangling_assignments(text: Column) -> Column:
    dropped = F.regexp_replace(text, DANGLING_LINE, "")
    return F.when(text.rlike(r"=[^\S\n]*\n"), dropped).otherwise(text)


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks inside a line become one space."""
    return F.regexp_replace(text, rf"{_BLANK}+", " ")


def collapse_whitespace(text: Column) -> Column:
    return collapse_spaces(trim_lines(text))


def strip_backticks(text: Column) -> Column:
    return F.replace(text, F.lit("`"), F.lit(""))


# --- begin/end balance ----------------------------------------------------


def balance_steps(lines: Column) -> Column:
    """Per line: does an ``end`` belong before it, and its change of depth."""
    def step(line: Column, i: Column) -> Column:
        def count(word: str) -> Column:
            exact = F.regexp_count(line, F.lit(rf"\b{word}\b"))
            return F.when(F.contains(line, F.lit(word)), exact).otherwise(0)

        begins, ends = count("begin"), count("end")
        orphan = (
            F.contains(line, F.lit("else"))
            & line.rlike(r"\belse\b")
            & ~line.rlike(r"\bend\b\s*else\b")
            & ~((begins == 1) & (ends == 1))
            & ~F.coalesce(F.get(lines, i - 1).rlike(r"\bend\s*$"), F.lit(False))
        )
        return F.struct(
            i.alias("i"), orphan.alias("orphan"), (begins - ends).alias("change")
        )

    return F.transform(lines, step)


FOLD_BLOCK = 256


def balance_blocks(lines: Column) -> Column:
    """Fold the steps: final depth, and per line whether it needs an ``end`` first.

    The fold appends to arrays, which copies them; it runs block by block, so
    that each copy is of one block and the work grows with the lines.
    """
    nothing = F.array().cast("array<boolean>")
    zero = F.struct(F.lit(0).alias("depth"), nothing.alias("closes"))

    def fold(state: Column, step: Column) -> Column:
        close = (state["depth"] > 0) & step["orphan"]
        depth = F.greatest(
            F.lit(0), state["depth"] - close.cast("int") + step["change"]
        )
        return F.struct(
            depth.alias("depth"), F.array_append(state["closes"], close).alias("closes")
        )

    def fold_block(state: Column, steps: Column) -> Column:
        start = F.struct(state["depth"].alias("depth"), nothing.alias("closes"))
        done = F.aggregate(steps, start, fold)
        return F.struct(
            done["depth"].alias("depth"), F.array_append(state["blocks"], done["closes"]).alias("blocks")
        )

    def folded(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / FOLD_BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(steps, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK))
        )
        start = F.struct(
            F.lit(0).alias("depth"), F.array().cast("array<array<boolean>>").alias("blocks")
        )
        return F.aggregate(blocks, start, fold_block, lambda s: F.struct(
            s["depth"].alias("depth"), F.flatten(s["blocks"]).alias("closes")
        ))

    nested = F.exists(lines, lambda line: F.contains(line, F.lit("begin")))
    # one-element transform: the steps are made once
    once = F.element_at(F.transform(F.array(balance_steps(lines)), folded), 1)
    return F.when(nested, once).otherwise(zero)


def insert_ends(lines: Column, closes: Column) -> Column:
    return F.transform(
        lines,
        lambda line, i: F.when(F.get(closes, i), F.concat(F.lit("end\n"), line)).otherwise(line),
    )


# --- audit ----------------------------------------------------------------


def leftover_hits(text: Column, words=R.COQ_KEYWORDS, binder: str = R.COQ_BINDER_REGEX) -> Column:
    """Lines that still match a literal or the binder form, once per pattern."""
    patterns = [R.any_literal([w]) for w in words] + [binder]
    kind = "array<struct<rule:int,line:string>>"
    suspects = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"(?i){'|'.join(patterns)}"))

    def matches(line: Column) -> Column:
        tests = [
            F.when(line.rlike(f"(?i){p}"), F.struct(F.lit(o).alias("rule"), line.alias("line")))
            for o, p in enumerate(patterns)
        ]
        return F.array_compact(F.array(*tests))

    return F.when(
        text.rlike(f"(?i){'|'.join(patterns)}"), F.flatten(F.transform(suspects, matches))
    ).otherwise(F.array().cast(kind))
