"""Decontamination, mixing, quality and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from corpusmill.llm import chunk_dedup, decontaminate, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).repartition(3)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window=10):
    tests = []
    for name, text in items:
        words = words_of(text)
        if words:
            tests += [(name if name is None else str(name), words[i : i + window]) for i in range(max(1, len(words) - window + 1))]
    out = []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for name, test in tests:
            for at in range(len(words) - len(test) + 1):
                if words[at : at + len(test)] == test:
                    hit.update(range(at, at + len(test)))
                    found.add(name)
        found.discard(None)  # hits, but in no list
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("set_bytes", [1 << 20, 400])
def test_contamination(spark, prose, set_bytes):
    """In one set of items, and in several passes."""
    items = [(1, prose(1, 40)), (2, prose(2, 10)), (3, "Short ITEM"), (4, "one"), (5, ""), (6, None), (None, prose(3, 20)),
             (1, prose(4, 15)), (10, "a a a a a a a a a a a a"), (11, "été où 12"), (12, " ".join(prose(1, 40).split()[5:20]))]
    one = prose(1, 40).split()
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, prose(9, 50)), (5, prose(9, 30) + " " + " ".join(one[3:17]) + " " + prose(8, 10)),
            (6, " ".join(one[:9])), (7, "x, SHORT-item! y"), (8, "a " * 40), (9, "one"), (10, "Été, où_12"), (10, "x"), (None, "one two"),
            (11, prose(2, 10).upper().replace(" ", " -- ")), (12, prose(7, 3000) + " " + prose(4, 15) + " " + prose(6, 3000)), (13, prose(3, 20))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(table(spark, [(i, t, "s") for i, t in docs]), benchmark, set_bytes=set_bytes)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_contamination(docs, items)


@pytest.mark.parametrize("set_bytes", [1 << 20, 40])
def test_keep_clean_decides_by_row(spark, prose, set_bytes):
    """Several null ids and a repeated id, of which one row holds an item."""
    benchmark = spark.createDataFrame([(1, prose(1, 12)), (2, prose(2, 12))], "item_id long, text string")
    held = prose(3, 20) + " " + prose(2, 12)
    rows = [(None, held), (None, prose(4, 20)), (None, prose(5, 20)), (None, None), (7, held), (7, prose(6, 20)), (8, prose(1, 12)), (9, "")]
    docs = table(spark, [(i, t, "s") for i, t in rows])
    out = decontaminate.keep_clean(docs, benchmark, set_bytes=set_bytes)
    assert out.schema == docs.schema
    want = [r for r in rows if r[1] not in (held, prose(1, 12))]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_contamination_of_nothing(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, [(1, "a b", "s")])
    (row,) = decontaminate.contamination(docs, benchmark).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    assert decontaminate.keep_clean(docs, benchmark).columns == docs.columns


def weights_by_hand(tokens, budget, max_repeats=None, entropy_share=None):
    total = sum(tokens.values())

    def at(a):
        power = {s: (n / total) ** a for s, n in tokens.items()}
        z = sum(power.values())
        return {s: p / z for s, p in power.items()}

    def ok(a):
        w = at(a)
        if max_repeats is not None:
            return max(w[s] * budget / tokens[s] for s in tokens) <= max_repeats
        return -sum(x * math.log(x) for x in w.values()) < entropy_share * math.log(len(tokens))

    low, high = 0.0, 1.0
    if ok(0.0):
        return at(0.0)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if ok(middle) else (middle, high)
    return at(high)


@pytest.mark.parametrize("options", [{"max_repeats": 2.0}, {"max_repeats": 1.0}, {"max_repeats": None, "entropy_share": 0.8}, {"budget": 700, "max_repeats": 1.5}])
def test_mix(spark, prose, options):
    rows = [(i, prose(i, 5 + i % 40), f"s{int(math.sqrt(i))}") for i in range(120)]
    rows += [(500, None, "s1"), (501, "", None), (502, "a b c", None), (503, None, "no words"), (None, "d e", "s2"), (7, prose(7, 12), "s2"), (7, prose(7, 12), "s2")]
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    del tokens["no words"]
    budget = options.get("budget", sum(tokens.values()))
    want = weights_by_hand(tokens, budget, options.get("max_repeats"), options.get("entropy_share"))
    drawn = mixing.mix(table(spark, rows), block_tokens=60, **options).collect()
    got, copies = defaultdict(int), Counter()
    for row in drawn:
        assert row.weight == pytest.approx(want[row.source], rel=1e-5)
        got[row.source] += row.tokens
        copies[row.source, row.doc_id, row.epoch] += 1
    longest = max(len((t or "").split()) for _, t, _ in rows) * 2
    for source, weight in want.items():
        assert weight * budget - longest <= got[source] <= weight * budget + 1e-3
    repeated = Counter((s, i) for i, _, s in rows)
    last = max(row.epoch for row in drawn)
    for (source, doc_id, _), n in copies.items():
        assert n <= repeated[source, doc_id]
    assert last <= (options.get("max_repeats") or 10)
    again = mixing.mix(table(spark, rows), block_tokens=60, **options).collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn))
    # whole passes hold every row of their source
    whole = {s: int(want[s] * budget * (1 + 1e-9) // tokens[s]) for s in want}
    for i, _, s in rows:
        if s in whole:
            assert sum(copies[s, i, e] for e in range(whole[s])) == whole[s] * repeated[s, i]


def test_mix_of_nothing(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(1, None, "a"), (2, " ", None)])).count() == 0


def test_quality_on_rows_not_learnt_from(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in quality.quality_scores(docs, quality.learn(docs, labels)).collect()}
    assert len(scores) == docs.count()
    right = []
    for row in labels.collect():
        mark = scores.get(row.doc_id)
        if mark is None:
            continue
        assert mark.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert mark.predicted == (mark.score >= quality.CUT)
        if mark.held_out:
            right.append(mark.predicted == row.quality)
    assert np.mean(right) >= 0.95


def test_quality_ignores_other_columns_and_labels_of_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    odd = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS score", "1 AS label", "2 AS id")
    one = quality.quality_scores(docs, quality.learn(docs, labels)).orderBy("doc_id").collect()
    two = quality.quality_scores(odd, quality.learn(odd, turned)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.predicted) for r in one] == [(r.doc_id, r.predicted) for r in two]
    assert max(abs(a.score - b.score) for a, b in zip(one, two, strict=True)) < 1e-9


def test_quality_of_odd_rows(spark, prose):
    rows = [(1, None, "a"), (2, "", "a"), (None, "text", "b"), (3, prose(1, 50_000), "c"), (3, "again", "c"), (4, "\U0001f600", None)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, quality.learn(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    empty = quality.learn(docs, labels.limit(0))
    assert {r.predicted for r in quality.quality_scores(docs, empty).collect()} == {1}
    assert quality.quality_scores(docs.limit(0), empty).count() == 0
    assert quality.keep_good(docs, empty).columns == docs.columns


def brute_pipeline_pairs(kept, width=5):
    sets = {}
    for i, text in kept:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, items in sets.items():
        for shingle in items:
            holders[shingle].append(i)
    met = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    for (a, b), both in met.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted(i for i in sets if root(i) == i)


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage against a brute-force version of it on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    ranking = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    marks = quality.quality_scores(docs, ranking).where("predicted = 1")
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in marks.collect()}
    single = stages["exact dedup"](spark, good, sf_dir).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())
    apart = stages["MinHash near-dedup"](spark, single, sf_dir).cache()
    assert sorted(r.doc_id for r in apart.collect()) == brute_pipeline_pairs([(r.doc_id, r.text) for r in single.collect()])
    clean = stages["benchmark decontamination"](spark, apart, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = brute_contamination([(r.doc_id, r.text) for r in apart.collect()], items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in rows if not r[5])
    assert clean.columns == docs.columns
    drawn = stages["mixing sources to target weights"](spark, clean, sf_dir).collect()
    assert {r.doc_id for r in drawn} <= {r.doc_id for r in clean.collect()}
    total, longest = 0, defaultdict(int)
    for r in clean.collect():
        total, longest[r.source] = total + len(r.text.split()), max(longest[r.source], len(r.text.split()))
    assert total - sum(longest.values()) <= sum(r.tokens for r in drawn) <= total


def test_exact_copies_leave_other_columns(spark):
    docs = table(spark, [(1, "a b", "s"), (2, "a  b", "t")]).withColumnRenamed("n_chars", "keep_id")
    (row,) = chunk_dedup.keep_first(docs).collect()
    assert (row.doc_id, row.source, row.keep_id) == (1, "s", 0)
