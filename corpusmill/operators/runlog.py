"""Training-log analytics: grids, early stopping, checkpoints, smoothing."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import running_max, with_group_rows

# The hyper-parameter grid.
GRID = {
    "batch_size": (4, 8),
    "learning_rate": (5e-5, 3e-5),
    "weight_decay": (0.01, 0.001),
    "warmup_steps": (500, 1000),
}
GRID_NAMES = tuple(GRID)


def grid_runs(runs: DataFrame, grid=GRID, job: str = "model") -> DataFrame:
    """Every configuration of the grid, its run name and its logged runs.

    Logged runs aggregate to at most one row per configuration before the
    (fixed-size) grid is joined to them.
    """
    schema = "batch_size int, learning_rate double, weight_decay double, warmup_steps int"
    configs = runs.sparkSession.createDataFrame(list(product(*grid.values())), schema)
    logged = runs.groupBy(*GRID_NAMES).agg(
        F.count_distinct("run").alias("n_runs"), F.count(F.lit(1)).alias("n_rows")
    )
    name = F.concat(
        F.lit(f"{job}_bs"), F.col("batch_size").cast("string"),
        F.lit("_lr"), F.col("learning_rate").cast("decimal(10,5)").cast("string"),
        F.lit("_wd"), F.col("weight_decay").cast("decimal(10,3)").cast("string"),
        F.lit("_ws"), F.col("warmup_steps").cast("string"),
    )
    return configs.join(logged, list(GRID_NAMES), "left").select(
        *GRID_NAMES, name.alias("run_name"),
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def best_parameters(runs: DataFrame, by: str = "run") -> DataFrame:
    """The settings of the highest composite; ties go to the earliest epoch."""
    best = F.max_by(
        F.struct(*GRID_NAMES, "epoch", "composite"), F.struct("composite", -F.col("epoch"))
    )
    return runs.groupBy(by).agg(best.alias("best")).select(by, "best.*")


def patience_counters(
    runs: DataFrame, score: str = "composite", key: str = "run", at: str = "epoch"
) -> DataFrame:
    """Running best, improvement and epochs since the last one (delta 0).

    An epoch improves when its score is at least the best so far. Epochs must
    run 1, 2, 3... per key.
    """
    rows = running_max(runs.select(key, at, score), key, at, score, "best_before")
    improved = F.col("best_before").isNull() | (F.col(score) >= F.col("best_before"))
    rows = rows.withColumn("improved", improved)
    rows = rows.withColumn("mark", F.when(F.col("improved"), F.col(at)))
    rows = running_max(rows, key, at, "mark", "last_improved", include_current=True)
    return rows.select(
        key, at, score, F.greatest(score, "best_before").alias("best"), "improved",
        (F.col(at) - F.col("last_improved")).alias("counter"),
    )


def early_stop(
    runs: DataFrame, patience: int = 3, delta: float = 0.0, score: str = "composite",
    key: str = "run", at: str = "epoch",
) -> DataFrame:
    """First epoch at which ``patience`` epochs brought no improvement."""
    if delta == 0:
        counters = patience_counters(runs, score, key, at)
        return counters.groupBy(key).agg(
            F.min(F.when(F.col("counter") == patience, F.col(at))).alias("stop_epoch"),
            F.max(at).alias("last_epoch"),
        )
    # With a delta the best depends on the path, but only a new maximum can
    # improve. Per run, new maxima alone are folded in order.
    rows = running_max(runs.select(key, at, score), key, at, score, "best_before")
    record = F.col("best_before").isNull() | (F.col(score) > F.col("best_before"))
    packed = rows.groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.when(record, F.struct(F.col(at).alias("at"), F.col(score).alias("s"))))
        ).alias("records"),
        F.max(at).alias("last_epoch"),
    )
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("since"),
        F.lit(None).cast("int").alias("stop"),
    )

    def fold(state, record):
        late = record["at"] - state["since"] > patience
        stop = F.coalesce(
            state["stop"],
            F.when(state["best"].isNotNull() & late, state["since"] + patience),
        )
        better = state["best"].isNull() | (record["s"] >= state["best"] + delta)
        return F.struct(
            F.when(better, record["s"]).otherwise(state["best"]).alias("best"),
            F.when(better, record["at"]).otherwise(state["since"]).alias("since"),
            stop.alias("stop"),
        )

    state = F.aggregate("records", start, fold)
    rest = F.when(
        F.col("last_epoch") - state["since"] >= patience, state["since"] + patience
    )
    return packed.select(key, F.coalesce(state["stop"], rest).alias("stop_epoch"), "last_epoch")


def best_checkpoint(runs: DataFrame, loss: str = "loss", key: str = "run") -> DataFrame:
    """Epoch of the lowest loss; ties go to the earliest."""
    best = F.min(F.struct(loss, "epoch"))
    return runs.groupBy(key).agg(best.alias("best")).select(
        key, F.col("best.epoch").alias("best_epoch"), F.col(f"best.{loss}").alias("best_loss")
    )


def epoch_losses(steps: DataFrame, key: str = "run") -> DataFrame:
    """Mean training and validation loss per run and epoch."""
    return steps.groupBy(key, "epoch").agg(
        *(
            F.avg(F.when(F.col("phase") == phase, F.col("loss"))).alias(f"{phase}_loss")
            for phase in ("train", "validation")
        ),
        F.count(F.lit(1)).alias("n_steps"),
    )


def smoothed_losses(runs: DataFrame, key: str = "run", at: str = "epoch") -> DataFrame:
    """Mean loss per window of one percent of a run's steps.

    The window width needs the row count of the run, which each block of steps
    gets by itself; a run of any length is spread over its blocks.
    """
    sized = with_group_rows(runs, key, at, "n")
    width = F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    window_no = F.floor((F.col(at) - 1) / width).cast("bigint")
    return sized.groupBy(key, window_no.alias("window_no")).agg(
        F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_steps")
    )
