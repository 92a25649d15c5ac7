"""Filter audit, personal data and periodic runs against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import filter_audit, periodic_runs, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ---


def brute_audit(rows, labels):
    """By the definition: every order applied to every row."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    masks = []
    for i, text, source in rows:
        text, words = text or "", WORD.findall(text or "")
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        masks.append((source or "", i, {f for f in fails if fails[f]}))
    out = {}
    for part in {m[0] for m in masks}:
        docs = [(i, f) for p, i, f in masks if p == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                fail = [d for d in docs if f in d[1]]
                out[part, "".join(order), step] = (
                    f, len(left), len(gone), len(fail) - len(gone), sum(d[1] == {f} for d in fail),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
        for key in [k for k in out if k[0] == part]:
            out[key] += (removed[out[key][0]],)
    return out


def odd_documents(prose):
    rng = random.Random(3)
    texts = [None, "", "A", "a # b", prose(1, 60), prose(1, 60), prose(2, 60).upper(), "x " * 80, prose(3, 49), "é" * 20, "A" + "\U0001f600" * 19, prose(4, 4000) + " |"]
    rows = [(i, t, "s" if i % 3 else None) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), rng.choice(["s", "t", "", None])) for i in range(60)]
    rows += [(None, prose(1, 60), "s"), (None, None, None), (4, prose(1, 60), "t"), (4, prose(1, 60), "t"), (5, "", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)]
    return rows, [*labels, (None, 1, 1), (4, 0, 1), (4, 1, 0), (999, 1, 1)]


def test_filter_audit(spark, prose):
    rows, labels = odd_documents(prose)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, part string")
    marks = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, mask int")
    found = filter_audit.filter_audit(docs.repartition(3), marks).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    assert len(got) == len(found) == 600 * 3
    assert got == brute_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    rows = filter_audit.filter_audit(one, labels).where("step = 1 AND filter = 'A'").collect()
    assert {(r.kept, r.removed, r.unique_fails, r.shapley) for r in rows} == {(0, 1, 1, 120)}


def test_diagram_swaps():
    """Each swap gives the diagram of the new order, built from scratch, node for node."""
    rng = random.Random(1)
    for n in (1, 2, 4, 5):
        counts = {m: (rng.randint(0, 3), rng.randint(0, 1)) for m in range(1 << n) if rng.random() < 0.7} or {0: (1, 1)}
        diagram = filter_audit.Diagram(counts, n)
        met = {tuple(diagram.order)}
        for level in filter_audit.adjacent_swaps(n):
            diagram.swap(level)
            met.add(tuple(diagram.order))
            for size in range(n + 1):
                kept = [w for m, w in counts.items() if not any(m >> f & 1 for f in diagram.order[:size])]
                want = tuple(map(sum, zip(*kept, strict=True))) or (0, 0)
                assert want == (diagram.weight[diagram.root] if not size else diagram.steps()[size - 1][1])
        assert len(met) == len(list(itertools.permutations(range(n))))


def test_equal_branches_are_stored_once():
    diagram = filter_audit.Diagram({m: (1,) for m in range(32)}, 5)
    assert len(diagram.weight) == 6


# --- periodic runs ---


def brute_runs(words, least):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in out.items())


def repetitive(rng, n):
    words: list[int] = []
    while len(words) < n:
        block = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
        words += block[: rng.randint(1, len(block))]
        if rng.random() < 0.3:
            words += words[-rng.randint(1, len(words)) :]
    return words


@pytest.mark.parametrize("least", [2, 12])
def test_runs(least):
    rng = random.Random(least)
    fibonacci, after = [0], [0, 1]
    for _ in range(9):
        fibonacci, after = after, after + fibonacci
    words = [repetitive(rng, rng.randint(0, 80)) for _ in range(400)]
    words += [[rng.randrange(2) for _ in range(rng.randint(0, 90))] for _ in range(300)] + [fibonacci[k : k + 100] for k in range(12)]
    words += [[0] * n for n in range(30)] + [list(range(40)) * 2, [0, 1] * 40 + [0] + [0, 1] * 40]
    for item in words:
        s, e, q = periodic_runs.find_runs(np.array(item, dtype=np.int64), least)
        assert list(zip(s.tolist(), q.tolist(), e.tolist(), strict=True)) == brute_runs(item, least)


def test_periodic_runs(spark, prose):
    rng = random.Random(5)
    texts = [None, "", " \t\x0b", "one", "a " * 5000, "a\x1cb " * 12 + " x", prose(1, 20000), "é " * 11, "b c " * 6, "b c " * 5]
    texts += [" ".join(map(str, repetitive(rng, rng.randint(5, 120)))) for _ in range(80)] + [prose(7, 300)] * 40
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, prose(9, 200)), (None, None), (3, "a " * 20), (3, "a " * 20)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, id string")
    found = periodic_runs.periodic_runs(docs.coalesce(1)).collect()
    assert len(found) == len(rows)
    planted = 0
    for (i, text), row in zip(rows, found, strict=True):
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words, 12)
        assert row.doc_id == i and row.n_runs == len(runs)
        top = min(runs, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
        want = (top[0], top[2] - top[0], top[1], 1000 * (top[2] - top[0]) // top[1]) if top else (None,) * 4
        assert (row.start, row.length, row.period, row.exponent_milli) == want
        listed = "".join(f"{s},{e - s},{q}\n" for s, q, e in sorted(runs))
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < e for s, q, e in runs)]
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (row.n_words, row.n_dropped) == (n, n - len(kept))
    assert planted >= 5
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_places():
    assert periodic_runs.planted_places(5, 7).tolist() == [0, 1, 2, 3, 4]
    # g = 12, n = 10: a = 2, p = 1 + 8 // (3 + 4) = 2
    assert periodic_runs.planted_places(10, 120).tolist() == [0, 1, 2, 3, 2, 3, 2, 3, 2, 3]


# --- personal data ---


def naive_base(text):
    """The patterns as given, leftmost and without overlap."""
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


ODD_TEXTS = [
    None, "", "a@b.c", "a@b.c_x@y.z d@e a@b@c.d. .%+-@x.y-", "é1.2.3.4.5.6.7.8é 256.1.1.1 0255.000001.1.1 ", "\U0001f6004539148803436467 4539-1488-0343-6467x",
    "4539148803436467 4539148803436467", "+1 (743) 555-3824 +1 (743) 555-38 +33 1 23 45 67 89)", "+1+12345678901", "1.2.3", "10.0.0.1@x.org", "+10.20.30.40 5", "45391488034364671",
]


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.make_examples([], 5))


def test_base_spans_of_personal_data():
    rng = random.Random(4)
    pieces = ["a", "@", ".", "b-", "+", "1", "23", "255", "256", " ", "-", "(", ")", "4539148803436467", "_", "é", "0"]
    texts = ODD_TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text or "") == naive_base(text)


def test_scans_are_linear(field):
    """Texts that a rescanning pattern would need minutes for."""
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000, "1.2." * 70_000, "+1 (" * 70_000, "(at) " * 50_000, "@" * 200_000):
        assert naive_base(text[:1000]) == pii.base_spans(text[:1000])
        field.spans([text], [pii.base_spans(text)])


def segmentations(lattice, node, last, label=0):
    """All (edges, labels) from a node on."""
    if node == last:
        yield [], [label]
    for e in np.flatnonzero(lattice.start == node):
        for edges, labels in segmentations(lattice, int(lattice.end[e]), last, int(lattice.label[e])):
            yield [int(e), *edges], [label, *labels]


def test_programs_against_all_segmentations():
    rng = np.random.default_rng(1)
    for text in ("(743) 555-3824 1", "1 234 567 890 1", "j. x (at) y . z 12345678"):
        n, candidates = pii.segments(text, 0, len(text))
        assert candidates
        lattice = pii.Lattice()
        lattice.add(n, candidates, 0)
        lattice.add(n, candidates, len(candidates))
        lattice.close()
        scores, follow = rng.normal(size=2 * len(candidates)), rng.normal(size=(5, 5))
        total, chance, uses = lattice.posterior(scores, follow)
        want_uses, want_chance = np.zeros((5, 5)), np.zeros(len(scores))
        for stretch, best in enumerate(lattice.best(scores, follow)):
            found = []
            for edges, labels in segmentations(lattice, int(lattice.first[stretch]), int(lattice.last[stretch])):
                used = [int(c) for c in lattice.candidate[edges] if c >= 0]
                value = scores[used].sum() + sum(follow[a, b] for a, b in itertools.pairwise(labels))
                found.append((value, used, labels))
            values = np.array([v for v, _, _ in found])
            assert total[stretch] == pytest.approx(np.logaddexp.reduce(values))
            assert best == max(found)[1]
            for value, used, labels in found:
                want_chance[used] += np.exp(value - total[stretch])
                for a, b in itertools.pairwise(labels):
                    want_uses[a, b] += np.exp(value - total[stretch])
        assert chance == pytest.approx(want_chance)
        assert uses == pytest.approx(want_uses)


def test_further_spans_of_held_out_examples(field):
    """Entities in other forms, with look-alikes, from another seed than the field's."""
    examples = pii.make_examples([], 77, each=100)
    want = {(i, *s) for i, (_, spans) in enumerate(examples) for s in spans}
    got = {(i, *s) for i, spans in enumerate(field.spans([t for t, _ in examples], [[]] * len(examples))) for s in spans}
    for kind in range(4):
        right = {s for s in want & got if s[2] == kind}
        assert len(right) >= 0.93 * sum(s[2] == kind for s in want)
        assert len(right) >= 0.93 * sum(s[2] == kind for s in got)


def test_find_personal_data(spark, field, prose):
    texts = [*ODD_TEXTS, prose(1, 3000) + " call (743) 555-3824 now", "write to jane at mail dot example dot org \U0001f600", prose(2, 500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.c"), (7, "a@b.c"), (7, "a@b.c")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kind int, id string")
    found = pii.find_personal_data(docs.coalesce(1), field).collect()
    for (i, text), row in zip(rows, found, strict=True):
        base = naive_base(text)
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert row.doc_id == i
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [x.split(":") for x in row.spans.split(",") if x]
        spans = [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in spans]
        added = sorted(set(spans) - set(base))
        assert spans == sorted(spans) and set(base) <= set(spans) and len(added) == row.n_added
        covered = np.zeros(len(text or "") + 1, dtype=int)
        for s, _, e in added:
            covered[s:e] += 1
            assert not any(s < z and a < e for a, _, z in base)
        assert covered.max() <= 1
    assert found[13].spans.endswith(f"phone:{len(texts[13]) - 18}:{len(texts[13]) - 4}")
    assert found[14].spans == "email:9:41"
    assert found[15].spans == ""
    assert pii.find_personal_data(docs.limit(0), field).count() == 0


def test_learning_is_bounded_and_repeatable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = pii.sampled_spans(docs.repartition(5), sample=40)
    assert 0 < len(spans) <= 40 and spans == pii.sampled_spans(docs, sample=40)
    assert all(len(v) <= 64 and len(b) <= pii.CONTEXT and len(a) <= pii.CONTEXT for _, v, b, a in spans)
    assert pii.sampled_spans(docs.limit(0)) == []
