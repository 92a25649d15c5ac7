"""Next-token counts, prediction metrics and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.tokens import pre_tokens
from corpusmill.operators import evaluate as E
from corpusmill.operators import ngram as G
from corpusmill.operators import runlog as L
from corpusmill.operators import split
from corpusmill.queries.base import Query, check
from corpusmill.queries.dedup import SPLIT_SQL
from corpusmill.queries.flagging import LABEL_VOCAB, label_vocab
from corpusmill.queries.reports import PRE
from corpusmill.sources import views as V

# --- next-token counts -----------------------------------------------------

WORD_ROWS = f"""
    SELECT split, regexp_extract_all(content, '{PRE}') AS ws FROM ({SPLIT_SQL}) s"""
PAIRS = """
    SELECT split, ws[i] AS context, ws[i + 1] AS next
    FROM (SELECT split, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM word_rows) p"""
TRAIN = "SELECT context, next, count(*) AS n FROM pairs WHERE split = 'train' GROUP BY ALL"
UNIGRAMS = """SELECT next, count(*) AS n FROM (SELECT unnest(ws) AS next FROM word_rows
    WHERE split = 'train') u GROUP BY next"""
RANKED = """SELECT *, rank() OVER (PARTITION BY context ORDER BY n DESC) AS rank,
    sum(n) OVER (PARTITION BY context) AS context_n FROM train"""
SCORED = """
    SELECT t.context, t.next, t.test_n, (coalesce(r.n, 0) + 1.0::DOUBLE)
           / (coalesce(c.context_n, 0) + v.size)::DOUBLE AS p_true, coalesce(r.rank, 0) AS rank
    FROM (SELECT context, next, count(*) AS test_n FROM pairs WHERE split = 'test' GROUP BY ALL) t
    LEFT JOIN ranked r ON r.context = t.context AND r.next = t.next
    LEFT JOIN (SELECT context, sum(n) AS context_n FROM train GROUP BY context) c
        ON c.context = t.context, (SELECT count(*) AS size FROM unigrams) v"""
_TOP = """
    SELECT context, next, CAST(row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS INTEGER) AS rank
    FROM {counts} QUALIFY rank <= 5"""
_NGRAM = {
    "word_rows": WORD_ROWS, "pairs": PAIRS, "train": TRAIN, "unigrams": UNIGRAMS,
    "ranked": RANKED, "scored": SCORED,
    "triples": """
    SELECT context, next, count(*) AS n FROM (
        SELECT ws[i] || ' ' || ws[i + 1] AS context, ws[i + 2] AS next
        FROM (SELECT ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM word_rows WHERE split = 'train') p)
    GROUP BY ALL""",
    "top3": _TOP.format(counts="triples"),
    "top2": _TOP.format(counts="train"),
    "contexts": """
    SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS context, ws[i + 1] AS shorter
    FROM (SELECT ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM word_rows WHERE split = 'test') p""",
}


def _ngram_sql(select: str, upto: str) -> str:
    names = list(_NGRAM)
    return check("corpus", select, **{n: _NGRAM[n] for n in names[: names.index(upto) + 1]})


def _part(spark, sf_dir, name: str):
    return split.assign_split(V.corpus(spark, sf_dir)).filter(F.col("split") == name)


def _predicted(spark, sf_dir):
    train = _part(spark, sf_dir, "train")
    contexts = _part(spark, sf_dir, "test").select(
        F.explode(pre_tokens(F.col("content"))).alias("context")
    ).distinct()
    return G.predict(contexts, G.bigram_counts(train), G.unigram_counts(train))


def _backed_off(spark, sf_dir):
    """Two-token contexts of the test part, looked up in orders 3, 2 and 1."""
    train = _part(spark, sf_dir, "train")
    contexts = G.ngram_counts(_part(spark, sf_dir, "test"), 3).select("context")
    counts = {3: G.ngram_counts(train, 3), 2: G.bigram_counts(train)}
    return G.predict_back_off(contexts, counts, G.unigram_counts(train))


def _ngram_metrics(spark, sf_dir):
    """The counts as a model among others: its predictions through the common metrics."""
    train = _part(spark, sf_dir, "train")
    rows = E.score_rows(G.predictions(_part(spark, sf_dir, "test"), G.bigram_counts(train)))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg((F.col("label") == F.col("pred")).cast("int")), 6).alias("accuracy"),
        F.round(F.avg("loss"), 6).alias("loss"),
    )


def _scored(spark, sf_dir):
    train = _part(spark, sf_dir, "train")
    size = G.unigram_counts(train).agg(F.count(F.lit(1)).alias("size")).scalar()
    return G.score(_part(spark, sf_dir, "test"), G.bigram_counts(train), size)


def _scored_by_orders(spark, sf_dir):
    return G.score_back_off(_part(spark, sf_dir, "test"), _part(spark, sf_dir, "train"), 3)


# Discounted shares and the weight left for the next lower order, for orders 3, 2 and 1.
_DISCOUNTED = {
    "c2": "SELECT split_part(context, ' ', 2) AS context, next, count(*) AS n FROM triples GROUP BY ALL",
    "c1": "SELECT '' AS context, next, count(*) AS n FROM train GROUP BY ALL",
    **{f"m{k}": f"""
    SELECT context, next, (n - 0.75) / sum(n) OVER (PARTITION BY context) AS share,
           0.75 * count(*) OVER (PARTITION BY context) / sum(n) OVER (PARTITION BY context) AS weight
    FROM {counts}""" for k, counts in ((3, "triples"), (2, "c2"), (1, "c1"))},
    **{f"w{k}": f"SELECT DISTINCT context, weight FROM m{k}" for k in (3, 2, 1)},
    "test3": """
    SELECT a || ' ' || b AS context, b, next, count(*) AS test_n FROM (
        SELECT ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS next
        FROM (SELECT ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM word_rows WHERE split = 'test') p)
    GROUP BY ALL""",
    "scored3": """
    SELECT t.context, t.next, t.test_n,
           coalesce(m3.share, 0) + coalesce(w3.weight, 1) * (coalesce(m2.share, 0) + coalesce(w2.weight, 1) * (
               coalesce(m1.share, 0) + (SELECT any_value(weight) FROM w1) / ((SELECT count(*) FROM unigrams) + 1))) AS p_true
    FROM test3 t LEFT JOIN m3 ON m3.context = t.context AND m3.next = t.next LEFT JOIN w3 ON w3.context = t.context
    LEFT JOIN m2 ON m2.context = t.b AND m2.next = t.next LEFT JOIN w2 ON w2.context = t.b
    LEFT JOIN m1 ON m1.next = t.next""",
}


# --- prediction metrics ----------------------------------------------------

ROWS = """
    SELECT model_id, batch_id, pos, label, CAST(list_position(l, top) - 1 AS INTEGER) AS pred,
           len(list_filter(l, lambda x: x > l[label + 1])) < 5 AS top_k,
           ln(z) + top - l[label + 1] AS loss,
           -list_sum(list_transform(l, lambda x: exp(x - top) / z * ln(exp(x - top) / z))) AS entropy,
           list_max(list_transform(l, lambda x: exp(x - top) / z)) AS confidence
    FROM (SELECT *, list_sum(list_transform(l, lambda x: exp(x - top))) AS z
          FROM (SELECT *, list_max(l) AS top FROM (SELECT *, logits::DOUBLE[] AS l FROM {view}) a) b) c"""
CLASSES = """
    SELECT coalesce(t.model_id, p.model_id) AS model_id, coalesce(t.batch_id, p.batch_id) AS batch_id,
           coalesce(t.c, p.c) AS class, coalesce(hits, 0) AS n_hit, coalesce(n_true, 0) AS n_true,
           coalesce(n_pred, 0) AS n_pred
    FROM (SELECT model_id, {by} AS batch_id, label AS c, count(*) AS n_true,
                 count(*) FILTER (label = pred) AS hits FROM scored GROUP BY ALL) t
    FULL JOIN (SELECT model_id, {by} AS batch_id, pred AS c, count(*) AS n_pred FROM scored GROUP BY ALL) p
    ON t.model_id = p.model_id AND t.batch_id = p.batch_id AND t.c = p.c"""
MACRO = """
    SELECT model_id, batch_id,
           avg(CASE WHEN n_pred = 0 THEN 0 ELSE n_hit / n_pred END) AS precision,
           avg(CASE WHEN n_true = 0 THEN 0 ELSE n_hit / n_true END) AS recall,
           avg(CASE WHEN n_hit = 0 THEN 0 ELSE 2 * (n_hit / n_pred) * (n_hit / n_true)
               / (n_hit / n_pred + n_hit / n_true) END) AS f1
    FROM classes GROUP BY model_id, batch_id"""
BATCHES = """
    SELECT s.*, m.precision, m.recall, m.f1 FROM (
        SELECT model_id, batch_id, avg(loss) AS loss,
               count(*) FILTER (label = pred) / count(*) AS accuracy,
               count(*) FILTER (top_k) / count(*) AS top5_accuracy, avg(entropy) AS entropy,
               avg(confidence) AS confidence FROM scored GROUP BY model_id, batch_id) s
    JOIN macro m ON s.model_id = m.model_id AND s.batch_id = m.batch_id"""
_MEANS = ", ".join(f"avg({m}) AS {m}" for m in E.METRICS if m != "perplexity")
RUNS = f"SELECT model_id, {_MEANS}, exp(avg(loss)) AS perplexity FROM batches GROUP BY model_id"


def _steps(view: str, by: str = "batch_id") -> dict[str, str]:
    return {
        "scored": ROWS.format(view=view), "classes": CLASSES.format(by=by), "macro": MACRO,
        "batches": BATCHES, "runs": RUNS,
    }


def _metric_sql(columns: str, source: str, view: str = "predictions", by: str = "batch_id") -> str:
    return check(view, f"SELECT {columns} FROM {source}", **_steps(view, by))


def _six(*names: str) -> str:
    return ", ".join(f"round({name}, 6) AS {name}" for name in names)


def _rows(spark, sf_dir):
    return E.score_rows(V.predictions(spark, sf_dir))


def _per_row(*columns: str):
    return lambda spark, d: E.rounded(_rows(spark, d).select("pos", *columns))


def _per_batch(*columns: str):
    return lambda spark, d: E.rounded(
        E.batch_metrics(_rows(spark, d)).select("batch_id", *columns)
    )


def _run(spark, sf_dir):
    return E.run_metrics(E.batch_metrics(_rows(spark, sf_dir)))


def _all_models(spark, sf_dir):
    scored = E.score_rows(V.two_models(spark, sf_dir))
    return E.run_metrics(E.batch_metrics(scored))


def _mean(*columns: str):
    return lambda spark, d: E.rounded(_run(spark, d).select("model_id", *columns))


def _composite(spark, sf_dir):
    run = _run(spark, sf_dir)
    value = E.composite(*(F.col(c) for c in ("accuracy", "precision", "recall", "f1")))
    return E.rounded(run.select("model_id", value.alias("composite")))


def _masked(spark, sf_dir):
    flagged = E.mask_flag(_rows(spark, sf_dir), label_vocab(spark, sf_dir))
    return E.rounded(E.masked_comparison(flagged))


_LONG = " UNION ALL ".join(
    f"SELECT model_id, '{m}' AS metric, round({m}, 6) AS value FROM runs" for m in E.METRICS
)

# --- training logs ---------------------------------------------------------

_GRID_ROWS = [
    (b, lr, wd, ws)
    for b in L.GRID["batch_size"]
    for lr in L.GRID["learning_rate"]
    for wd in L.GRID["weight_decay"]
    for ws in L.GRID["warmup_steps"]
]
GRID = "SELECT * FROM (VALUES " + ", ".join(
    f"({b}, {lr:.5f}::DOUBLE, {wd:.3f}::DOUBLE, {ws}, 'model_bs{b}_lr{lr:.5f}_wd{wd:.3f}_ws{ws}')"
    for b, lr, wd, ws in _GRID_ROWS
) + ") g(batch_size, learning_rate, weight_decay, warmup_steps, run_name)"
IMPROVED = """
    SELECT run, epoch, composite, composite >= coalesce(max(composite) OVER before, composite) AS improved,
           max(composite) OVER (PARTITION BY run ORDER BY epoch) AS best
    FROM run_log WINDOW before AS (PARTITION BY run ORDER BY epoch
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
ISLANDS = """
    SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY epoch) - 1 AS counter
    FROM (SELECT *, sum(CASE WHEN improved THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch)
                 AS island FROM improved) i"""
_COUNTERS = {"improved": IMPROVED, "islands": ISLANDS}


def _log(spark, sf_dir):
    return V.run_log(spark, sf_dir)


def _early_delta(spark, sf_dir):
    return L.early_stop(_log(spark, sf_dir), patience=5, delta=0.02)


# The path-dependent best as a recursion over epochs, independent of the fold.
_DELTA_SQL = """
WITH RECURSIVE run_log AS ({log}), walk AS (
    SELECT run, epoch, composite AS best, 0 AS counter FROM run_log WHERE epoch = 1
    UNION ALL
    SELECT r.run, r.epoch, CASE WHEN r.composite >= w.best + 0.02 THEN r.composite ELSE w.best END,
           CASE WHEN r.composite >= w.best + 0.02 THEN 0 ELSE w.counter + 1 END
    FROM walk w JOIN run_log r ON r.run = w.run AND r.epoch = w.epoch + 1)
SELECT run, min(epoch) FILTER (counter = 5) AS stop_epoch, max(epoch) AS last_epoch
FROM walk GROUP BY run"""


def _checkpoints(spark, sf_dir):
    return L.best_checkpoint(_log(spark, sf_dir))


def _epoch_losses(spark, sf_dir):
    steps = _log(spark, sf_dir).drop("epoch").withColumnRenamed("day", "epoch")
    return E.rounded(L.epoch_losses(steps))


QUERIES = {
    "M1_bigram_counts": Query(
        lambda spark, d: G.bigram_counts(_part(spark, d, "train")),
        _ngram_sql("SELECT context, next, n FROM train", "train"),
    ),
    "M2_predict_next": Query(
        _predicted,
        _ngram_sql(
            """SELECT c.context, r.rank, r.next, false AS backed_off
               FROM (SELECT DISTINCT unnest(ws) AS context FROM word_rows WHERE split = 'test') c
               JOIN (SELECT context, next, CAST(row_number() OVER (PARTITION BY context
                            ORDER BY n DESC, next) AS INTEGER) AS rank FROM train) r
                 ON r.context = c.context AND r.rank <= 5
               UNION ALL
               SELECT c.context, u.rank, u.next, true
               FROM (SELECT DISTINCT unnest(ws) AS context FROM word_rows WHERE split = 'test') c,
                    (SELECT next, CAST(row_number() OVER (ORDER BY n DESC, next) AS INTEGER) AS rank
                     FROM unigrams QUALIFY rank <= 5) u
               WHERE c.context NOT IN (SELECT context FROM train)""", "unigrams"),
    ),
    "M1_trigram_counts": Query(
        lambda spark, d: G.ngram_counts(_part(spark, d, "train"), 3),
        _ngram_sql("SELECT context, next, n FROM triples", "triples"),
    ),
    "M2_predict_back_off": Query(
        _backed_off,
        _ngram_sql(
            """SELECT c.context, 3 AS "order", r.rank, r.next FROM contexts c JOIN top3 r USING (context)
               UNION ALL
               SELECT c.context, 2, r.rank, r.next FROM contexts c JOIN top2 r ON r.context = c.shorter
               WHERE c.context NOT IN (SELECT context FROM triples)
               UNION ALL
               SELECT c.context, 1, u.rank, u.next FROM contexts c, (
                   SELECT next, CAST(row_number() OVER (ORDER BY n DESC, next) AS INTEGER) AS rank
                   FROM unigrams QUALIFY rank <= 5) u
               WHERE c.context NOT IN (SELECT context FROM triples)
                 AND c.shorter NOT IN (SELECT context FROM train)""", "contexts"),
    ),
    "M6_ngram_metrics": Query(
        _ngram_metrics,
        _ngram_sql(
            """SELECT count(*) AS n_rows, round(avg(CASE WHEN label = pred THEN 1 ELSE 0 END), 6) AS accuracy,
                      round(avg(loss), 6) AS loss
               FROM (SELECT label, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred,
                            ln(list_sum(list_transform(l, lambda x: x + 1))) - ln(l[label + 1] + 1) AS loss
                     FROM (SELECT ns || [context_n - list_sum(ns)] AS l,
                                  coalesce(list_position(nexts, next) - 1, 9) AS label
                           FROM (SELECT next, unnest(range(test_n)) AS copy, coalesce(context_n, 0) AS context_n,
                                        list_resize(coalesce(ns, []), 9, 0) AS ns, nexts
                                 FROM (SELECT context, next, count(*) AS test_n FROM pairs
                                       WHERE split = 'test' GROUP BY ALL) t
                                 LEFT JOIN (SELECT context, list(n ORDER BY n DESC, next) FILTER (rank <= 9) AS ns,
                                                   list(next ORDER BY n DESC, next) FILTER (rank <= 9) AS nexts,
                                                   sum(n)::BIGINT AS context_n
                                            FROM (SELECT *, row_number() OVER (PARTITION BY context
                                                      ORDER BY n DESC, next) AS rank FROM train) r
                                            GROUP BY context) m USING (context)) a) b) c""", "contexts"),
    ),
    "M3_score_pairs": Query(
        lambda spark, d: _scored(spark, d).select(
            "context", "next", "test_n", F.round("p_true", 6).alias("p_true"),
            F.col("rank").cast("bigint").alias("rank"),
        ),
        _ngram_sql("SELECT context, next, test_n, round(p_true, 6) AS p_true, rank FROM scored",
                   "scored"),
    ),
    "M3_score_summary": Query(
        lambda spark, d: G.score_summary(_scored(spark, d)),
        _ngram_sql(
            """SELECT CAST(sum(test_n) AS BIGINT) AS n_pairs, round(loss, 6) AS loss,
                      round(exp(loss), 2) AS perplexity, round(any_value(t1) / sum(test_n), 6) AS top1,
                      round(any_value(t5) / sum(test_n), 6) AS topk
               FROM scored, (SELECT sum(-ln(p_true) * test_n) / sum(test_n) AS loss,
                    sum(CASE WHEN rank = 1 THEN test_n ELSE 0 END) AS t1,
                    sum(CASE WHEN rank BETWEEN 1 AND 5 THEN test_n ELSE 0 END) AS t5 FROM scored) s
               GROUP BY loss""", "scored"),
    ),
    "M3_score_order_3": Query(
        lambda spark, d: _scored_by_orders(spark, d).select(
            "context", "next", "test_n", F.round("p_true", 9).alias("p_true")
        ),
        check("corpus", "SELECT context, next, test_n, round(p_true, 9) AS p_true FROM scored3",
              **{n: _NGRAM[n] for n in ("word_rows", "pairs", "train", "unigrams", "triples")}, **_DISCOUNTED),
    ),
    "K5_argmax": Query(_per_row("pred"), _metric_sql("pos, pred", "scored")),
    "K6_top_k_membership": Query(_per_row("top_k"), _metric_sql("pos, top_k", "scored")),
    "M4_cross_entropy": Query(_per_row("loss"), _metric_sql("pos, " + _six("loss"), "scored")),
    "M4_batch_loss": Query(_per_batch("loss"), _metric_sql("batch_id, " + _six("loss"), "batches")),
    "M5_perplexity": Query(
        _mean("loss", "perplexity"), _metric_sql("model_id, " + _six("loss", "perplexity"), "runs")
    ),
    "M6_accuracy": Query(_mean("accuracy"), _metric_sql("model_id, " + _six("accuracy"), "runs")),
    "M7_macro_scores": Query(
        _per_batch("precision", "recall", "f1"),
        _metric_sql("batch_id, " + _six("precision", "recall", "f1"), "batches"),
    ),
    "M7_global_scores": Query(
        lambda spark, d: E.rounded(
            E.global_scores(_rows(spark, d)).select("model_id", "accuracy", "precision", "recall", "f1")
        ),
        check("predictions", """SELECT m.model_id, round(a.accuracy, 6) AS accuracy,
                  round(m.precision, 6) AS precision, round(m.recall, 6) AS recall, round(m.f1, 6) AS f1
              FROM macro m JOIN (SELECT model_id, count(*) FILTER (label = pred) / count(*) AS accuracy
                                 FROM scored GROUP BY model_id) a ON a.model_id = m.model_id""",
              **{k: v for k, v in _steps("predictions", "0").items() if k in ("scored", "classes", "macro")}),
    ),
    "M8_top5_accuracy": Query(
        _mean("top5_accuracy"), _metric_sql("model_id, " + _six("top5_accuracy"), "runs")
    ),
    "M9_entropy": Query(_mean("entropy"), _metric_sql("model_id, " + _six("entropy"), "runs")),
    "M10_confidence": Query(
        _mean("confidence"), _metric_sql("model_id, " + _six("confidence"), "runs")
    ),
    "M11_composite": Query(
        _composite,
        _metric_sql("model_id, round(0.1 * accuracy + 0.2 * precision + 0.2 * recall + 0.5 * f1, 6) "
                    "AS composite", "runs"),
    ),
    "M12_batch_series": Query(
        _per_batch("accuracy", "precision", "recall", "f1"),
        _metric_sql("batch_id, " + _six("accuracy", "precision", "recall", "f1"), "batches"),
    ),
    "M13_metrics_long": Query(
        lambda spark, d: E.rounded(E.long_form(_run(spark, d))),
        check("predictions", f"SELECT * FROM ({_LONG}) l", **_steps("predictions")),
    ),
    "M14_masked_comparison": Query(
        _masked,
        check("predictions", r"""SELECT model_id, variant, count(*) AS n_positions,
                  round(avg(loss), 6) AS loss, round(exp(avg(loss)), 6) AS perplexity,
                  round(count(*) FILTER (label = pred) / count(*), 6) AS accuracy
              FROM scored s JOIN vocab v ON s.label = v.id,
                   (VALUES ('unmasked'), ('masked')) t(variant)
              WHERE variant = 'unmasked' OR NOT regexp_matches(v.token, '^(VAR|MODULE|SUBMODULE)\d+')
              GROUP BY model_id, variant""",
              scored=ROWS.format(view="predictions"), vocab=LABEL_VOCAB),
    ),
    "M15_compare_models": Query(
        lambda spark, d: E.rounded(E.compare_models(E.long_form(_all_models(spark, d)), ("a", "b"))),
        check("two_models", f"SELECT metric, max(value) FILTER (model_id = 'a') AS a, "
              f"max(value) FILTER (model_id = 'b') AS b FROM ({_LONG}) l GROUP BY metric",
              **_steps("two_models")),
    ),
    "M16_all_models": Query(
        lambda spark, d: E.rounded(_all_models(spark, d)),
        _metric_sql("model_id, " + _six(*E.METRICS), "runs", "two_models"),
    ),
    "A13_mean_over_batches": Query(
        _mean("accuracy", "precision", "recall", "f1"),
        _metric_sql("model_id, " + _six("accuracy", "precision", "recall", "f1"), "runs"),
    ),
    "R1_grid_runs": Query(
        lambda spark, d: L.grid_runs(_log(spark, d)),
        check("run_log", """SELECT g.*, count(DISTINCT r.run) AS n_runs, count(r.run) AS n_rows
              FROM grid g LEFT JOIN run_log r USING (batch_size, learning_rate, weight_decay, warmup_steps)
              GROUP BY ALL""", grid=GRID),
    ),
    "R2_best_parameters": Query(
        lambda spark, d: L.best_parameters(_log(spark, d)),
        check("run_log", """SELECT run, batch_size, learning_rate, weight_decay, warmup_steps, epoch, composite
              FROM run_log QUALIFY row_number() OVER (PARTITION BY run ORDER BY composite DESC, epoch) = 1"""),
    ),
    "R3_early_stop": Query(
        lambda spark, d: L.early_stop(_log(spark, d)),
        check("run_log", """SELECT run, min(epoch) FILTER (counter = 3) AS stop_epoch,
              max(epoch) AS last_epoch FROM islands GROUP BY run""", **_COUNTERS),
    ),
    "R3_early_stop_delta": Query(
        _early_delta,
        _DELTA_SQL.format(log="SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY ts, event_id) "
                          f"AS INTEGER) AS epoch FROM ({V.RUN_LOG}) log"),
    ),
    "W4_patience_counters": Query(
        lambda spark, d: L.patience_counters(_log(spark, d)).select(
            "run", "epoch", "best", "improved", F.col("counter").cast("bigint").alias("counter")
        ),
        check("run_log", "SELECT run, epoch, best, improved, counter FROM islands", **_COUNTERS),
    ),
    "R4_best_checkpoint": Query(
        _checkpoints,
        check("run_log", """SELECT run, epoch AS best_epoch, loss AS best_loss FROM run_log
              QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1"""),
    ),
    "R5_epoch_losses": Query(
        _epoch_losses,
        check("run_log", """SELECT run, day AS epoch, round(avg(loss) FILTER (phase = 'train'), 6) AS train_loss,
              round(avg(loss) FILTER (phase = 'validation'), 6) AS validation_loss, count(*) AS n_steps
              FROM run_log GROUP BY run, day"""),
    ),
    "W6_smoothed_losses": Query(
        lambda spark, d: E.rounded(L.smoothed_losses(_log(spark, d))),
        check("run_log", """SELECT run, CAST(floor((epoch - 1) / greatest(1, floor(n / 100))) AS BIGINT)
                  AS window_no, round(avg(loss), 6) AS mean_loss, count(*) AS n_steps
              FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM run_log) l GROUP BY ALL"""),
    ),
}


