"""Anonymisation on hand-written rows and as properties."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import identifiers as I
from corpusmill.operators import anonymize as A


def anonymized(corpus_of, content):
    return A.anonymize(corpus_of({"a.v": content})).first()


def test_underscores_stay_in_meaningful_words_only(texts):
    code = "foo_bar data_in u$clk $$x my_data_in next_state _ data_in2"
    assert texts(I.strip_underscores, [code]) == ["foobar datain uclk x mydatain nextstate  datain2"]
    assert texts(I.strip_underscores_except, [code]) == [
        "foobar data_in u$clk x mydatain next_state  datain2"
    ]


def test_reserved_and_meaningful_names_stay(corpus_of):
    row = anonymized(corpus_of, "module top(input clk, output addr);\nassign addr = clk;\nendmodule")
    assert row["content"] == (
        "module MODULE1(input clk, output addr);\nassign addr = clk;\nendmodule"
    )
    assert row["quarantine"] is None


def test_names_that_differ_only_in_underscores_merge(corpus_of):
    row = anonymized(corpus_of, "module m; foo_bar = foobar; endmodule")
    assert row["content"] == "module MODULE1; VAR1 = VAR1; endmodule"


def test_a_placeholder_in_the_source_is_renamed_once(corpus_of):
    row = anonymized(corpus_of, "module m; VAR3 = a + b; endmodule")
    names = re.findall(r"VAR\d+", row["content"])
    assert sorted(names) == ["VAR1", "VAR2", "VAR3"]


def test_instances_and_their_modules(corpus_of):
    code = "module top;\nleaf one(x);\nleaf two(x);\nendmodule\nmodule leaf(x);\nendmodule"
    row = anonymized(corpus_of, code)
    shape = re.sub(r"\d+", "#", row["content"])
    assert shape == (
        "module MODULE#;\nMODULE# SUBMODULE#(VAR#);\nMODULE# SUBMODULE#(VAR#);\nendmodule\n"
        "module MODULE#(VAR#);\nendmodule"
    )


def test_number_texts_are_not_identifiers(corpus_of):
    row = anonymized(corpus_of, "module m; q = 8'hFF + 4'b01; endmodule")
    assert row["content"] == "module MODULE1; VAR1 = 8'hFF + 4'b01; endmodule"


def test_text_without_module_gets_a_header(corpus_of):
    row = anonymized(corpus_of, "assign q = 1;")
    assert row["content"] == "module MODULE1(\nassign VAR1 = 1;"


def test_meaningful_parts_are_numbered(corpus_of):
    row = anonymized(corpus_of, "module m; endmodule module x; m u$clk(); m v$clk(); endmodule")
    assert " clk();" in row["content"] and " clk1();" in row["content"]


def test_banned_words_blank_their_line(corpus_of):
    row = anonymized(corpus_of, "module m;\nwire sim, a;\nb = a;\nendmodule")
    assert row["banned"] == ["sim"] and row["content"].split("\n")[1] == ""
    assert row["quarantine"] is None


def test_unexplained_identifiers_are_quarantined(corpus_of):
    df = A.anonymize(corpus_of({"a.v": "module m; include x; endmodule", "b.v": "module m; endmodule"}))
    assert [r["path"] for r in A.quarantined(df).collect()] == ["a.v"]
    assert [r["path"] for r in A.released(df).collect()] == ["b.v"]


def test_order_depends_on_seed_not_on_position(corpus_of):
    code = "module m; " + " ".join(f"sig{i}" for i in range(30)) + "; endmodule"
    first = anonymized(corpus_of, code)["content"]
    again = anonymized(corpus_of, code)["content"]
    other = A.anonymize(corpus_of({"a.v": code}), seed=7).first()["content"]
    numbers = [int(n) for n in re.findall(r"VAR(\d+)", first)]
    assert first == again != other and numbers != sorted(numbers)
    assert sorted(numbers) == list(range(1, 31))


def test_bijection_check(corpus_of, spark):
    renames = A.rename_rows(corpus_of({"a.v": "module m; a = b + c; endmodule"}))
    A.assert_bijection(renames)
    broken = renames.withColumn("replacement", F.lit("VAR1"))
    with pytest.raises(ValueError):
        A.assert_bijection(broken)


def test_many_identifiers(corpus_of):
    code = "module m; " + " ".join(f"s{i}x" for i in range(20000)) + " endmodule"
    numbers = re.findall(r"VAR(\d+)", anonymized(corpus_of, code)["content"])
    assert len(set(numbers)) == 20000


def test_compare_sample(corpus_of):
    before = corpus_of({f"{i}.v": f"module m{i}; x = {i}; endmodule" for i in range(20)})
    rows = A.compare_sample(before, A.anonymize(before), 5).collect()
    assert len(rows) == 5
    for row in rows:
        assert f"m{row['doc_id']};" in row["original_content"] and "MODULE1" in row["content"]


TOKENS = st.lists(
    st.sampled_from(["foo", "bar", "clk", "wire", "assign", " ", "=", ";", "8'hA1", "q1", "\n", "(", ")"]),
    min_size=1, max_size=20,
).map("".join)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TOKENS, min_size=20, max_size=40))
def test_everything_but_names_is_preserved(corpus_of, contents):
    df = A.rewrite(corpus_of({f"{i}.v": f"module m;{c}" for i, c in enumerate(contents)}))
    kept = set(R.VERILOG_KEYWORDS) | set(R.MEANINGFUL_WORDS)
    for row in df.select("doc_id", "code", "renames").collect():
        names = {r["name"]: r["replacement"] for r in row["renames"]}
        assert len(set(names.values())) == len(names) and not kept & set(names)
        runs = re.findall(r"[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+", f"module m;{contents[row['doc_id']]}")
        assert row["code"] == "".join(names.get(run, run) for run in runs)


COLLIDING = """module x$clk(input clk);
leaf u$clk();
leaf v$clk();
endmodule
module leaf(input data);
endmodule
"""


def test_kept_words_are_numbered_apart_from_all_identifiers(corpus_of):
    docs = corpus_of({"a.v": COLLIDING})
    rows = A.rename_rows(docs).collect()
    kept = {row["name"]: row["replacement"] for row in rows if row["kind"] == "kept"}
    assert kept == {"x$clk": "clk1", "u$clk": "clk2", "v$clk": "clk3"}
    A.assert_bijection(A.rename_rows(docs))
    assert A.anonymize(docs).first()["quarantine"] is None


def test_many_names_take_bounded_time(corpus_of):
    import time

    names = " ".join(f"wire name_{i} = u{i}$clk;" for i in range(10_000))
    docs = corpus_of({"a.v": f"module top(input clk);\n{names}\nendmodule"})
    start = time.perf_counter()
    assert A.anonymize(docs).first()["quarantine"] is None
    assert time.perf_counter() - start < 60


def test_long_files_take_linear_time(spark):
    """Many modules, many open headers: each would take minutes if every one were searched for each other."""
    import time

    from pyspark.sql import functions as F

    from corpusmill.functions import identifiers as I
    from corpusmill.functions import text as X

    modules = " ".join(f"module m{i}; m{i - 1} u{i} (x); endmodule" for i in range(5_000))
    opened = "module a " * 20_000
    rows = spark.createDataFrame([(1, modules), (2, opened), (3, opened + ";"), (4, "module a; " + opened)], "i int, t string")
    start = time.time()
    found = rows.select(
        "i", X.has_module_header(F.col("t")).alias("has"), F.length(X.mask_module_headers(F.col("t"))).alias("n"),
        F.size(I.instance_names(F.col("t"), I.module_names(F.col("t")))).alias("instances"),
    ).orderBy("i").collect()
    assert [r["has"] for r in found] == [True, False, True, True]
    assert found[0]["instances"] == 4_999
    assert [r["n"] for r in found[1:]] == [len(opened), len(opened) + 1, len(opened) + 10]
    assert time.time() - start < 45
