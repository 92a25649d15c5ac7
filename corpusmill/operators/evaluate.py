"""Metrics over a predictions table, for all models and batches in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import logits as L

IGNORE_LABEL = -100
METRICS = (
    "loss", "perplexity", "accuracy", "precision", "recall", "f1", "top5_accuracy",
    "entropy", "confidence",
)


def score_rows(predictions: DataFrame, k: int = 5, ignore_label: int = IGNORE_LABEL) -> DataFrame:
    """Per position: prediction, hit, top-k hit, loss, entropy, confidence.

    ``counted`` is false for ignored labels; they stay in the table.
    """
    rows = predictions.withColumn("l", L.as_doubles(F.col("logits")))
    l, label = F.col("l"), F.col("label")
    counted = label != ignore_label
    return rows.select(
        "model_id", "batch_id", "pos", "label",
        L.argmax(l).alias("pred"), counted.alias("counted"),
        F.when(counted, L.in_top_k(l, label, k)).otherwise(F.lit(False)).alias("top_k"),
        F.when(counted, L.cross_entropy(l, label)).alias("loss"),
        L.entropy(l).alias("entropy"), L.confidence(l).alias("confidence"),
    )


def class_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Per class: how often true, predicted and both.

    Each row adds to its label's class and its prediction's class, so labels
    and predictions meet in one aggregation instead of an outer join.
    """
    hit = F.col("label") == F.col("pred")
    one = F.array(F.struct(
        F.col("label").alias("class"), F.lit(1).alias("t"), F.lit(1).alias("p"), F.lit(1).alias("tp")
    ))
    two = F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 F.lit(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                 F.lit(0).alias("tp")),
    )
    rows = scored.filter("counted").select(*by, F.inline(F.when(hit, one).otherwise(two)))
    return rows.groupBy(*by, "class").agg(
        F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum("tp").alias("n_hit")
    )


def macro_scores(counts: DataFrame, *by: str) -> DataFrame:
    """Accuracy, and unweighted means over classes; an empty class scores zero."""
    precision = F.coalesce(F.try_divide("n_hit", "n_pred"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("n_hit", "n_true"), F.lit(0.0))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("n_hit"), F.col("n_true") + F.col("n_pred")), F.lit(0.0)
    )
    return counts.groupBy(*by).agg(
        F.try_divide(F.sum("n_hit"), F.sum("n_true")).alias("accuracy"),
        F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1")
    )


def batch_metrics(scored: DataFrame) -> DataFrame:
    """The batch-wise series: one row per model and batch."""
    by = ("model_id", "batch_id")
    means = scored.groupBy(*by).agg(
        F.avg("loss").alias("loss"),
        F.avg(F.col("top_k").cast("int")).alias("top5_accuracy"),
        F.avg("entropy").alias("entropy"), F.avg("confidence").alias("confidence"),
    )
    return means.join(macro_scores(class_counts(scored, *by), *by), list(by), "left")


def run_metrics(batches: DataFrame) -> DataFrame:
    """Means over batches; perplexity is the exponential of the mean loss."""
    names = [name for name in METRICS if name != "perplexity"]
    means = batches.groupBy("model_id").agg(*(F.avg(name).alias(name) for name in names))
    return means.withColumn("perplexity", F.exp("loss")).select("model_id", *METRICS)


def global_scores(scored: DataFrame) -> DataFrame:
    """The variant that scores all rows of a model at once."""
    return macro_scores(class_counts(scored, "model_id"), "model_id")


def composite(accuracy: Column, precision: Column, recall: Column, f1: Column) -> Column:
    return 0.1 * accuracy + 0.2 * precision + 0.2 * recall + 0.5 * f1


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        *(F.round(c, digits).alias(c) if kinds[c] == "double" else c for c in df.columns)
    )


def long_form(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot("model_id", list(METRICS), "metric", "value")


def mask_flag(scored: DataFrame, vocab: DataFrame, pattern: str = R.PLACEHOLDER_REGEX) -> DataFrame:
    """Add ``masked``: the label's token is a placeholder."""
    flags = vocab.select(F.col("id").alias("label"), F.col("token").rlike(pattern).alias("masked"))
    return scored.join(flags, "label", "left").withColumn(
        "masked", F.coalesce("masked", F.lit(False))
    )


def masked_comparison(flagged: DataFrame) -> DataFrame:
    """Loss, perplexity and accuracy with and without masked labels."""
    hit = (F.col("pred") == F.col("label")).cast("int")
    counted, open_ = F.col("counted"), F.col("counted") & ~F.col("masked")
    sums = flagged.groupBy("model_id").agg(
        *(
            agg.alias(f"{name}_{what}")
            for name, test in (("unmasked", counted), ("masked", open_))
            for what, agg in (
                ("n", F.count_if(test)), ("loss", F.avg(F.when(test, F.col("loss")))),
                ("accuracy", F.avg(F.when(test, hit))),
            )
        )
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("variant"), F.col(f"{name}_n").alias("n_positions"),
                F.col(f"{name}_loss").alias("loss"), F.exp(f"{name}_loss").alias("perplexity"),
                F.col(f"{name}_accuracy").alias("accuracy"),
            )
            for name in ("unmasked", "masked")
        )
    )
    return sums.select("model_id", F.inline(rows))


def compare_models(long: DataFrame, models, by: str = "metric") -> DataFrame:
    """One column per model."""
    return long.groupBy(by).pivot("model_id", list(models)).agg(F.first("value"))
