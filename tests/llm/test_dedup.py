"""Exact and near dedup against brute force over small tables with odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import arrays, chunk_dedup, near_dedup
from corpusmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, kept boolean, row int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 1, 2) for i, t in rows], SCHEMA).repartition(3)


def brute_exact(rows):
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    seen, out = set(), []
    for i, t in normal:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        first = (i, t) not in seen
        seen.add((i, t))
        out.append((i, keep, len(groups[t]), first and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_rows(prose):
    long_text = prose(1, 40_000)
    rows = [
        (5, "a  b"), (4, "a\tb"), (9, "a b"), (9, "a b"), (7, ""), (8, None), (None, "a b"), (None, "alone"),
        (None, "alone"), (10, " "), (11, "\n"), (12, long_text), (13, long_text), (14, long_text + "x"),
        (15, "é b"), (16, "é b"), (17, "\U0001f600 a"), (18, "a b"), (19, prose(2, 900)),
    ]
    return rows + [(100 + i, prose(3, 300)) for i in range(40)]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, odd_rows, bits):
    """With 3-bit hashes nearly every chunk shares its hash, and verification must tell them apart."""
    found = chunk_dedup.exact_groups(table(spark, odd_rows), bits=bits).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_exact(odd_rows)


def test_keep_first(spark, odd_rows):
    docs = table(spark, odd_rows)
    out = chunk_dedup.keep_first(docs)
    assert out.columns == docs.columns
    want = sorted(((i, i is None or None) for i, k, _, kept, _ in brute_exact(odd_rows) if kept), key=str)
    assert sorted(((r.doc_id, r.doc_id is None or None) for r in out.collect()), key=str) == want


def test_empty_table(spark):
    assert chunk_dedup.exact_groups(table(spark, [])).count() == 0
    assert near_dedup.near_groups(table(spark, [])).count() == 0
    assert chunk_dedup.keep_first(table(spark, [])).count() == 0
    assert near_dedup.keep_one(table(spark, [])).count() == 0


def test_chunks_are_the_text_and_find_their_place_again(spark, prose):
    from pyspark.sql import functions as F

    text = prose(5, 6000)
    rows = spark.createDataFrame([(0, text), (1, "a few words more " + text)], "i int, t string")
    one, two = (r["c"] for r in rows.select("i", chunk_dedup.chunks(F.col("t")).alias("c")).orderBy("i").collect())
    assert "".join(one) == text
    assert max(map(len, one)) <= chunk_dedup.MAX_CHUNK + 8
    assert len(set(one) & set(two)) >= 0.9 * len(one)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_near(rows, width, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        members[root(x)].append(i)
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [m for m in members[root(x)] if m is not None]
        least = min(ids) if ids else None
        out.append((i, len(sets[x]), least, i == least))
    return sorted(out, key=str)


def changed(text, places, mark):
    words = text.split(" ")
    for place in places:
        words[place % len(words)] = f"{mark}{place}"
    return " ".join(words)


def near_rows(prose):
    rng = np.random.default_rng(3)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, "one two three"), (None, "one two"), (None, "x y z q")]
    number = 10
    for seed, size in ((1, 60), (2, 70), (3, 400), (4, 3000), (5, 20), (6, 64), (7, 80)):
        text = prose(seed, size)
        for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.2):
            edits = rng.integers(size, size=int(size * share))
            rows.append((number, changed(text, edits.tolist(), f"v{number}x")))
            number += 1
    passage = prose(50, 60)
    for k in range(60):  # a passage that many documents share, by itself no link
        rows.append((number, passage + " " + prose(1000 + k, 70)))
        number += 1
    for k in range(25):  # a chain: neighbours are linked, ends are not
        rows.append((number, " ".join(prose(77, 400).split(" ")[k * 8 : k * 8 + 160])))
        number += 1
    return [*rows, (20, rows[20][1]), (21, "other text under an id that stands twice")]


@pytest.mark.parametrize(("width", "most"), [(4, 32), (5, 2)])
def test_near_groups(spark, prose, width, most):
    """With lists of two, nearly all links are found by way of leaders and what they lack."""
    rows = near_rows(prose)
    text = prose(99, 150)
    rng = np.random.default_rng(9)
    for k in range(90):  # a cloud of copies around a text that is not among them
        rows.append((900 + k, changed(text, rng.integers(150, size=1 + k % 6).tolist(), f"w{k % 40}x")))
    found = near_dedup.near_groups(table(spark, rows), width=width, most=most).collect()
    want = brute_near(rows, width)
    assert sorted((tuple(r) for r in found), key=str) == want
    assert sum(not row[3] for row in want) > 40


@pytest.mark.parametrize("width", [4, 5])
def test_isolated_pairs_of_every_size_about_the_sketch(spark, prose, width):
    """Pairs that share nothing with a third row: one word replaced, one inserted, the tail cut."""
    rows = []
    for size in range(40, 81):
        edits = (
            lambda words: [*words[:20], "other", *words[21:]],
            lambda words: [*words[:20], "other", *words[20:]],
            lambda words: words[: width - 1 - (-len(words[width - 1 :]) * 80 // 100)],
        )
        for kind, edit in enumerate(edits):
            words = prose(10_000 + 3 * size + kind, size + width - 1).split(" ")
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edit(words)))]
    found = near_dedup.near_groups(table(spark, rows), width=width).collect()
    want = brute_near(rows, width)
    assert sorted((tuple(r) for r in found), key=str) == want
    assert sum(not row[3] for row in want) > 115


def test_keep_one(spark, prose):
    rows = [r for r in near_rows(prose)[:-2] if r[0] is not None]
    out = near_dedup.keep_one(table(spark, rows))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").replace(" int", "").split(", ")
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, _, kept in brute_near(rows, 5) if kept)


def test_keep_one_decides_by_row(spark, prose):
    """Several null ids and a repeated id, of which one row is a near copy."""
    rows = [
        (1, prose(1, 50)), (None, prose(1, 50) + " more"), (None, prose(2, 50)), (None, prose(3, 50)), (None, ""), (None, None),
        (7, prose(1, 50) + " other"), (7, prose(4, 50)), (8, prose(5, 50)), (8, prose(6, 50)),
    ]
    out = near_dedup.keep_one(table(spark, rows))
    assert out.schema == table(spark, rows).schema
    gone = {rows[1], rows[6]}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted((r for r in rows if r not in gone), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabAB éß\U0001f600", max_size=30), max_size=6))
def test_word_spans(texts):
    data = "".join(texts).encode()
    sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    starts, ends, rows = arrays.word_spans(np.frombuffer(data, np.uint8), offsets, arrays.SPACED)
    found = [(int(r), data[a:b].decode()) for a, b, r in zip(starts, ends, rows, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (300, 200), (5, 5), (None, 4), (7, None), (200, 100)]
    edges += [(1000, 2000 + i) for i in range(500)] + [(900, 2100)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100} | {1000: 900, 900: 900}
    assert found == want | {2000 + i: 900 for i in range(500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bound_of_long_lists_counts_what_the_other_cut_leaves_out(spark):
    """Sets of 800 and 1,000, one inside the other, that share 500 with the leader: linked at exactly 0.8."""
    import numpy as np

    for seed in range(3):
        values = np.random.default_rng(seed).choice(1 << 40, 500, replace=False).astype(np.int64)
        small, large = np.sort(values[:300]).tolist(), np.sort(values).tolist()
        clouds = spark.createDataFrame(
            [(1, 2, 500, 800, 500, False, small), (1, 3, 500, 1000, 500, False, large)],
            "leader long, node long, n_leader long, n long, met long, linked boolean, outside array<long>",
        ).coalesce(1)
        rows = near_dedup._outside_lists(clouds, 80).collect()
        assert {r.node for r in rows} == {2, 3}
        assert all(r.bound >= 800 for r in rows)
