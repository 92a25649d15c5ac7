"""Hand-written rows for the text rules and the whole cleaner."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import text as X
from corpusmill.operators import clean


def cleaned(corpus_of, content, **options):
    rows = clean.clean(corpus_of({"a.v": content}), **options).collect()
    return rows[0]


def test_line_comment_joins_the_next_line(texts):
    assert texts(X.strip_comments, ["a; // c\nb;\n", "x; // tail"]) == ["a; b;\n", "x; tail"]


def test_block_and_attribute_comments_span_lines(texts):
    assert texts(X.strip_comments, ["a /* x\ny */ b", "a (* k\nz *) b", None, ""]) == [
        "a  b", "a  b", "", "",
    ]


def test_line_endings(texts):
    assert texts(X.normalize_line_endings, ["a\r\nb\rc\n"]) == ["a\nb\nc\n"]


def test_directive_lines_and_blank_lines_above(texts):
    code = "wire a;\n\n  `define X 1\n`elsewhere y\nwire b;\n`undef Q"
    assert texts(X.strip_directives, [code]) == ["wire a;\nwire b;\n`undef Q"]


def test_conditional_directives_can_stay(texts):
    code = "`ifdef A\n`define B\nx\n`endif\n"
    assert texts(lambda t: X.strip_directives(t, keep_conditional=True), [code]) == [
        "`ifdef A\nx\n`endif\n"
    ]


def test_headers_are_masked_only_when_there_are_several(texts):
    one = "module a(input x); wire y; endmodule"
    two = one + " module b #(parameter W=8)(input z); endmodule"
    assert texts(X.mask_module_headers, [one, two]) == [
        one, " wire y; endmodule  endmodule",
    ]


SAMPLES = {
    0: "a -> b", 1: "$display(x);", 2: '$readmemb("f", m);', 3: '$readmemh("f", m);',
    4: "$write;", 5: "$writeh;", 6: "$monitor(a);", 7: "$strobe(a);", 8: "$finish(1);",
    9: "$finish;", 10: "$stop(1);", 11: "$time;", 12: "#5'd10;", 13: "#5 ;",
    14: "always @(posedge $x);", 15: '$fopen("f");', 16: "$fwrite(f);", 17: "$fread(f);",
    18: "$fclose(f);", 19: '$dumpfile("f");', 20: "$dumpvars(0);", 21: "$assert(a);",
    22: "$random;", 23: "$urandom;", 24: "$period;", 25: "$realtime;", 26: "$timeformat;",
    27: "`timescale 1ns\n", 28: "specparam x = 1;", 29: "defparam a.sim_x;",
    30: "defparam a.log_level;", 31: "defparam a.b = c ; // simulation;", 32: "$setup;",
    33: "$hold (a);", 34: "$sdf_annotate;", 35: "covergroup;", 36: "$coverage_on;",
    37: "$test$plusargs;", 38: "$value$plusargs;", 39: "$signed;", 40: "$unsigned;",
    41: "$cast;", 42: "$size;", 43: "$fatal;", 44: "$error;", 45: "$warning;", 46: "$info;",
    47: "initial x `ifdef SIMULATION;", 48: "$system;", 49: "$exit;", 50: "$countones;",
    51: "$onehot;", 52: "$onehot0;", 53: "$isunknown;", 54: "$sampled;", 55: "$past;",
    56: "$rose;", 57: "$fell;", 58: "$stable;", 59: "$changed;", 60: "  # directive;", 61: "#any",
}


def test_every_fragment_rule_fires_once(texts):
    found = texts(X.matched_fragments, [SAMPLES[i] for i in range(len(SAMPLES))])
    assert len(SAMPLES) == len(R.NON_SYNTHESIZABLE_REGEXES)
    missing = [i for i, hits in enumerate(found) if i not in {hit["rule"] for hit in hits}]
    assert missing == []


def test_fragments_are_removed_everywhere_longest_first(texts):
    def remove(t):
        return X.remove_fragments(t, X.matched_fragments(t)["fragment"])

    # As a literal, "#5" also eats the start of "#50"; longest first avoids it here.
    assert texts(remove, ["x #50; #5; c#5;d"]) == ["x   cd"]
    assert texts(X.remove_scoped, ["x #50; #5; c#5;d"]) == ["x   cd"]


def test_trim_drops_empty_lines(texts):
    assert texts(X.trim_lines, ["  a \n\t\n\n b \n", "   ", ""]) == ["a\nb", "", ""]


def test_unknown_directive_lines(texts):
    code = "`foo bar\n`module x\n`pragma once\n# 5\nkeep\n`\nmodule\n"
    assert texts(X.drop_unknown_directives, [code]) == ["`module x\nkeep\nmodule\n"]


def test_initial_block_closes_on_a_lone_end(texts):
    code = "a\ninitial begin\nb\nbegin\nend x\nend\nc\nend\n"
    assert texts(X.drop_initial_blocks, [code]) == ["a\nbegin\nc\nend\n"]
    assert texts(lambda t: X.drop_initial_blocks(t, until_eof=True), [code]) == ["a\nbegin\n"]


def test_initial_assignment_is_no_block(texts):
    assert texts(X.drop_initial_blocks, ["initial x = 1;\ny\n"]) == ["initial x = 1;\ny\n"]


def test_marked_blocks(texts):
    code = "a\nspecify\nb\nbegin\nendspecify\nc\nQed x\nd\nLemma y\ne\n"
    assert texts(X.drop_marked_blocks, [code]) == ["a\nbegin\nc\nd\n"]


def test_first_listed_keyword_per_line(texts):
    code = "Lemma x := y\nwire prefix;\nassign checksum = 1;\nplain\n"
    assert texts(X.literal_hits, [code]) == [["Lemma ", "fix", "Check"]]
    assert texts(lambda t: X.literal_hits(t, word_boundary=True), ["wire prefix;\nfix it\n"]) == [
        ["fix"]
    ]


def test_single_lines_and_dangling_assignments(texts):
    assert texts(X.drop_single_lines, ["include x\nforced\nforce a;\nb\n"]) == ["forced\nb\n"]
    assert texts(X.drop_dangling_assignments, ["a =\nb = 1;\nc <=\nd ==\n"]) == [
        "b = 1;\nc <=\nd ==\n"
    ]


def test_balance_injects_end_before_an_orphan_else(corpus_of):
    row = cleaned(corpus_of, "module m(a);\nbegin\nx = 1;\nelse y = 2;\nendmodule")
    assert row["content"] == "module m(a);\nbegin\nx = 1;\nend\nelse y = 2;\nendmodule"
    assert not row["unbalanced"]


@pytest.mark.parametrize(
    ("code", "unbalanced"),
    [
        ("begin\nx;\nend", False), ("begin\nx;", True), ("end\nend\nbegin\nx;\nend", False),
        ("if (a) begin\nx;\nend else begin\ny;\nend", False),
    ],
)
def test_unbalanced_flag(corpus_of, code, unbalanced):
    assert cleaned(corpus_of, code)["unbalanced"] is unbalanced


def test_hidden_coq_line_still_flags_its_file(corpus_of):
    row = cleaned(corpus_of, "module m(a);\nLemma x.\nwire b;\nQed\nendmodule")
    assert row["coq_flag"] and row["coq_keywords"] == ["Lemma ", "Qed"]
    assert row["content"] == "module m(a);\nendmodule"


def test_empty_and_null_content(corpus_of):
    for content in ("", None):
        row = cleaned(corpus_of, content)
        assert (row["content"], row["coq_flag"], row["coq_keywords"]) == ("", False, [])


def test_backticks_go_last(corpus_of):
    assert cleaned(corpus_of, "wire [`W:0] a;")["content"] == "wire [W:0] a;"


def test_window_audit_agrees_with_the_text_rule(spark, corpus_of):
    code = "a\nspecify\nb\nbegin\nendspecify\nc\nQed x\nd\nLemma y\ne"
    df = corpus_of({"a.v": code}).withColumn("code", X.terminated_lines(F.col("content")))
    kept = clean.block_states(df).filter("NOT dropped").orderBy("line_no").collect()
    text = df.select(X.drop_marked_blocks(F.col("code")).alias("t")).first()["t"]
    assert "".join(row["line"] + "\n" for row in kept) == text


def test_module_pattern_is_linear(texts):
    hostile = "module m " + "a(b)" * 5000
    assert texts(lambda t: t.rlike(R.MODULE_HEADER_REGEX), [hostile, hostile + ";"]) == [False, True]


def test_long_file_stays_fast(corpus_of):
    code = "begin\n" * 3 + "\n".join(f"x{i} = {i};" for i in range(40000)) + "\nelse y;\nLemma q\n" * 2
    row = cleaned(corpus_of, code)
    assert row["unbalanced"] and row["coq_flag"]


LINES = st.lists(
    st.sampled_from([
        "begin", "end", "else x;", "initial begin", "initial", "a = 1;", "specify", "endspecify",
        "if (q) begin", "end else begin", " w ", "", "`foo", "a =", "#5 b;", "Lemma k", "$time;",
    ]), max_size=12,
).map("\n".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LINES, min_size=20, max_size=40))
def test_cleaned_text_has_tidy_lines(corpus_of, contents):
    rows = clean.clean(corpus_of({f"{i}.v": c for i, c in enumerate(contents)})).collect()
    for row in rows:
        lines = row["content"].split("\n") if row["content"] else []
        assert all(line and line == line.strip() for line in lines)


def fold_reference(lines):
    """The balance rule written out as a plain loop."""
    import re

    depth, out, previous = 0, [], ""
    for line in lines:
        begins, ends = (len(re.findall(rf"\b{w}\b", line)) for w in ("begin", "end"))
        if (
            depth > 0 and re.search(r"\belse\b", line) and not re.search(r"\bend\b\s*else\b", line)
            and not (begins == 1 and ends == 1) and not re.search(r"\bend\s*$", previous)
        ):
            out.append("end")
            depth -= 1
        depth = max(0, depth + begins - ends)
        out.append(line)
        previous = line
    return out, depth


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(
    ["begin", "end", "else x;", "a;", "if begin", "end else begin", "x end", "else begin y; end"]
), min_size=1, max_size=10), min_size=20, max_size=40))
def test_balance_equals_a_plain_loop(spark, documents):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, lines array<string>")
    found = rows.withColumn("b", X.balance_blocks(F.col("lines"))).select(
        "i", F.col("b.depth").alias("depth"),
        F.array_join(X.insert_ends(F.col("lines"), F.col("b.closes")), "\n").alias("text"),
    )
    for row in found.collect():
        lines, depth = fold_reference(documents[row["i"]])
        assert (row["text"], row["depth"]) == ("\n".join(lines), depth)


def test_a_rule_without_a_guard_is_always_searched_for(texts):
    rules = (r"foo|\$bar", r"\$stop\b", "plain")
    (found,) = texts(lambda t: X.matched_fragments(t, rules), ["foo here, $bar and plain"])
    assert sorted((row["rule"], row["fragment"]) for row in found) == [(0, "$bar"), (0, "foo"), (2, "plain")]
    (found,) = texts(lambda t: X.matched_fragments(t, rules), ["foo here"])
    assert [(row["rule"], row["fragment"]) for row in found] == [(0, "foo")]


def test_guards_stand_in_every_match():
    for pattern, guard in R.FRAGMENT_GUARDS.items():
        assert guard in pattern.replace("\\", ""), pattern


def test_many_orphan_lines_take_bounded_time(texts):
    import time

    code = "begin\n" + "if (a) begin\nx;\nelse y;\n" * 7_000
    start = time.perf_counter()

    def balanced(text):
        balance = X.balance_blocks(F.split(text, "\n"))
        return F.struct(balance["depth"], F.size(F.filter(balance["closes"], lambda c: c)))

    (found,) = texts(balanced, [code])
    assert tuple(found) == (1, 7_000)
    assert time.perf_counter() - start < 60
