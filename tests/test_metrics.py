"""Prediction metrics, next-token counts and training logs on toy tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import evaluate as E
from corpusmill.operators import ngram as G
from corpusmill.operators import ranking
from corpusmill.operators import runlog as L
from corpusmill.schemas import PREDICTIONS

ROWS = [
    ("m", 0, 0, 0, [2.0, 1.0, 0.0]), ("m", 0, 1, 1, [2.0, 1.0, 0.0]),
    ("m", 0, 2, 2, [0.0, 3.0, 1.0]), ("m", 1, 3, -100, [9.0, 0.0, 0.0]),
    ("m", 1, 4, 1, [0.0, 5.0, 5.0]),
]


@pytest.fixture(scope="module")
def scored(spark):
    return E.score_rows(spark.createDataFrame(ROWS, PREDICTIONS), k=2)


def test_row_scores(scored):
    rows = scored.orderBy("pos").collect()
    assert [r["pred"] for r in rows] == [0, 0, 1, 0, 1]
    assert [r["counted"] for r in rows] == [True, True, True, False, True]
    assert [r["top_k"] for r in rows] == [True, True, True, False, True]
    z = sum(math.exp(x) for x in (2, 1, 0))
    assert rows[1]["loss"] == pytest.approx(math.log(z) - 1) and rows[3]["loss"] is None
    assert rows[0]["confidence"] == pytest.approx(math.exp(2) / z)
    entropy = -sum(math.exp(x) / z * (x - math.log(z)) for x in (2, 1, 0))
    assert rows[0]["entropy"] == pytest.approx(entropy)


def test_macro_scores_with_empty_classes(scored):
    row = E.batch_metrics(scored).filter("batch_id = 0").first()
    # true 0 1 2, predicted 0 0 1: class 2 is never predicted
    assert row["accuracy"] == pytest.approx(1 / 3)
    assert row["precision"] == pytest.approx((1 / 2 + 0 + 0) / 3)
    assert row["recall"] == pytest.approx(1 / 3)
    assert row["f1"] == pytest.approx((2 / 3) / 3)


def test_run_metrics_average_batches(scored):
    batches = E.batch_metrics(scored)
    losses = [r["loss"] for r in batches.collect()]
    run = E.run_metrics(batches).first()
    assert run["loss"] == pytest.approx(sum(losses) / 2)
    assert run["perplexity"] == pytest.approx(math.exp(run["loss"]))


def test_masked_comparison(spark, scored):
    vocab = spark.createDataFrame([("VAR1", 0), ("xVAR1", 1), ("MODULE7", 2)], "token string, id int")
    rows = {r["variant"]: r for r in E.masked_comparison(E.mask_flag(scored, vocab)).collect()}
    assert (rows["unmasked"]["n_positions"], rows["masked"]["n_positions"]) == (4, 2)


def test_composite_and_long_form(spark, scored):
    value = spark.range(1).select(E.composite(*(F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)))).first()[0]
    assert value == pytest.approx(0.31)
    long = E.long_form(E.run_metrics(E.batch_metrics(scored)))
    assert {r["metric"] for r in long.collect()} == set(E.METRICS)


def test_bigrams_and_back_off(corpus_of, spark):
    train = corpus_of({"a": "x y x y x z", "b": "", "c": "q"})
    bigrams = G.bigram_counts(train)
    assert {tuple(r) for r in bigrams.collect()} == {("x", "y", 2), ("y", "x", 2), ("x", "z", 1)}
    contexts = spark.createDataFrame([("x",), ("new",)], "context string")
    rows = G.predict(contexts, bigrams, G.unigram_counts(train), 2).collect()
    found = {(r["context"], r["rank"]): (r["next"], r["backed_off"]) for r in rows}
    assert found == {
        ("x", 1): ("y", False), ("x", 2): ("z", False), ("new", 1): ("x", True),
        ("new", 2): ("y", True),
    }
    scored = {(r["context"], r["next"]): r for r in G.score(corpus_of({"t": "x y w"}), bigrams, 4).collect()}
    assert scored["x", "y"]["p_true"] == pytest.approx(3 / 7) and scored["x", "y"]["rank"] == 1
    assert scored["y", "w"]["p_true"] == pytest.approx(1 / 6) and scored["y", "w"]["rank"] == 0


def log_of(spark, scores):
    rows = [("r", i + 1, float(s)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "run string, epoch int, composite double")


def stop_by_loop(scores, patience, delta):
    best, counter = None, 0
    for epoch, score in enumerate(scores, 1):
        if best is None or score >= best + delta:
            best, counter = score, 0
        else:
            counter += 1
            if counter == patience:
                return epoch
    return None


def test_equality_counts_as_improvement(spark):
    row = L.early_stop(log_of(spark, [0.1, 0.2, 0.2, 0.19, 0.18, 0.3])).first()
    assert row["stop_epoch"] is None
    assert L.early_stop(log_of(spark, [0.1, 0.2, 0.2, 0.19, 0.18, 0.3]), patience=2).first()[
        "stop_epoch"
    ] == 5


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=14), min_size=8, max_size=16))
def test_early_stop_equals_a_plain_loop(spark, runs):
    rows = [(str(r), i + 1, s / 8) for r, scores in enumerate(runs) for i, s in enumerate(scores)]
    log = spark.createDataFrame(rows, "run string, epoch int, composite double")
    for delta in (0.0, 0.25):
        for row in L.early_stop(log, 2, delta).collect():
            expected = stop_by_loop([s / 8 for s in runs[int(row["run"])]], 2, delta)
            assert row["stop_epoch"] == expected


def test_ranks_and_running_values_across_blocks(spark):
    rows = [("k", i, (i * 37) % 101) for i in range(300)] + [("j", 0, 5)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    best, expected = -1, {}
    for _, i, v in rows[:300]:
        expected[i] = best if best >= 0 else None
        best = max(best, v)
    found = ranking.running_max(df, "k", "p", "v", "m", block_rows=7).filter("k = 'k'").collect()
    assert {r["p"]: r["m"] for r in found} == expected
    ranked = ranking.rank_within(df, "k", F.floor(F.col("p") / 9), "p").filter("k = 'k'").collect()
    assert all(r["rank"] == r["p"] + 1 for r in ranked)


def test_checkpoints_and_parameters(spark):
    rows = [
        ("r", 1, 4, 5e-5, 0.01, 500, 0.9, 0.2), ("r", 2, 8, 3e-5, 0.001, 1000, 0.5, 0.7),
        ("r", 3, 8, 3e-5, 0.001, 1000, 0.5, 0.7),
    ]
    log = spark.createDataFrame(
        rows, "run string, epoch int, batch_size int, learning_rate double, weight_decay double, "
        "warmup_steps int, loss double, composite double")
    assert tuple(L.best_checkpoint(log).first()) == ("r", 2, 0.5)
    best = L.best_parameters(log).first()
    assert (best["batch_size"], best["epoch"]) == (8, 2)
    grid = L.grid_runs(log).collect()
    assert len(grid) == 16 and sum(r["n_rows"] for r in grid) == 3
    assert "model_bs4_lr0.00005_wd0.010_ws500" in {r["run_name"] for r in grid}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_back_off_probabilities_add_up(spark, corpus_of, order):
    """Over all tokens and the unknown one, in seen and unseen contexts."""
    train = corpus_of({"a": "a b c a b d a b c c c", "b": "b c a", "c": "", "d": "d"})
    tokens = ["a", "b", "c", "d", "zz"]
    contexts = ["a b c", "a b d", "zz a b", "zz zz zz", "c c c"]
    docs = corpus_of({f"{i}.{j}": " ".join([*c.split()[4 - order :], t]) for i, c in enumerate(contexts) for j, t in enumerate(tokens)})
    scored = G.score_back_off(docs, train, order)
    sums = scored.groupBy("context").agg(F.sum("p_true").alias("p"), F.count("*").alias("n")).collect()
    assert sums and all(r["p"] == pytest.approx(1) for r in sums if r["n"] == len(tokens))
    assert scored.where("p_true <= 0").count() == 0
    assert G.score_back_off(docs, train.limit(0), order).where("abs(p_true - 1) > 1e-12").count() == 0


def test_back_off_by_hand(corpus_of):
    """a b (2), a c (1), b a (1): the share of b after a, and its share among the continuations."""
    train = corpus_of({"x": "a b a c", "y": "a b"})
    row = G.score_back_off(corpus_of({"t": "a b"}), train, 2).first()
    one = (1 - 0.75) / 3 + 0.75 * 3 / 3 / (3 + 1)  # b follows one token; three pairs in all
    assert row["p_true"] == pytest.approx((2 - 0.75) / 3 + 0.75 * 2 / 3 * one)


def test_back_off_counts_the_starts_of_rows(corpus_of):
    """Order 3 by brute force: rows of one and two tokens, and starts that nothing precedes, count in the lower orders."""
    train = ["a b c a b", "b c", "d", "a b c", "e b c a", "", None, "c, a b", "f f f f"]
    test = ["a b c a b c", "d e b c", "x b c f f f", "b c", "f f, a x y z", None]
    cut = [re.findall(r"\w+|[^\w\s]+", text or "") for text in train]
    grams = {k: [tuple(w[i : i + k]) for w in cut for i in range(len(w) - k + 1)] for k in (1, 2, 3)}
    counts = {3: Counter(grams[3]), 2: Counter(g[1:] for g in set(grams[3])), 1: Counter(g[1:] for g in set(grams[2]))}

    def chance(gram):
        if not gram:
            return 1 / (len(set(grams[1])) + 1)
        held = counts[len(gram)]
        same = [n for g, n in held.items() if g[:-1] == gram[:-1]]
        if not same:
            return chance(gram[1:])
        return (max(held[gram] - 0.75, 0) + 0.75 * len(same) * chance(gram[1:])) / sum(same)

    wanted = Counter(tuple(w[i : i + 3]) for text in test for w in [re.findall(r"\w+|[^\w\s]+", text or "")] for i in range(len(w) - 2))
    made = lambda texts: corpus_of({str(i): text for i, text in enumerate(texts)})
    found = {(*r["context"].split(" "), r["next"]): r for r in G.score_back_off(made(test), made(train), 3).collect()}
    assert {g: r["test_n"] for g, r in found.items()} == wanted
    assert all(r["p_true"] == pytest.approx(chance(g)) for g, r in found.items())
    shares, weights = G.back_off_model(made(train), 3)[2]
    assert {(r["context"], r["next"]) for r in shares.collect()} == set(counts[2])
    assert {r["context"] for r in weights.collect()} == {g[0] for g in counts[2]}


def test_smoothing_does_not_join_a_run_in_one_task(spark):
    steps = spark.range(1, 40001).selectExpr("'hot' AS run", "id AS epoch", "double(id % 7) AS loss")
    plan = L.smoothed_losses(steps)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and all("size_block#" in line for line in joins)
    rows = L.smoothed_losses(steps).collect()
    assert len(rows) == 100 and sum(r["n_steps"] for r in rows) == 40000
    assert {r["n_steps"] for r in rows} == {400}
