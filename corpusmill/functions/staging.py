"""Keep expensive columns from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, *names: str) -> DataFrame:
    """Pass ``names`` through a one-row generator.

    Catalyst pushes filters below projections by repeating their expressions.
    It does not push below a generator, so a filter on one of these columns
    reads the finished value instead of running the text rules again.
    """
    others = [name for name in df.columns if name not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(*df.columns)
