"""Scores of one prediction row; logits arrays are read, never collected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(logits: Column) -> Column:
    return logits.cast("array<double>")


def argmax(logits: Column) -> Column:
    """Index of the first highest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def in_top_k(logits: Column, label: Column, k: int = 5) -> Column:
    """Fewer than ``k`` logits are strictly greater than the true one."""
    true = F.get(logits, label)
    return F.size(F.filter(logits, lambda x: x > true)) < k


def exp_sum(logits: Column) -> Column:
    """Sum of exponentials relative to the highest logit."""
    top = F.array_max(logits)
    return F.aggregate(logits, F.lit(0.0), lambda total, x: total + F.exp(x - top))


def cross_entropy(logits: Column, label: Column) -> Column:
    return F.log(exp_sum(logits)) + F.array_max(logits) - F.get(logits, label)


def entropy(logits: Column) -> Column:
    """Entropy of the softmax: log Z minus the expected logit."""
    top, z = F.array_max(logits), exp_sum(logits)
    weighted = F.aggregate(
        logits, F.lit(0.0), lambda total, x: total + F.exp(x - top) * (x - top)
    )
    return F.log(z) - weighted / z


def confidence(logits: Column) -> Column:
    return 1 / exp_sum(logits)
