"""Connected components by large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import written


EDGES_PER_TASK = 100_000


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (else the smaller) neighbours of each node to its least neighbour.

    The least neighbour is a partial aggregate, so a hub costs one row per
    task; the join back is left to skew handling. A hub that is itself the
    least of its neighbourhood keeps its edges as they are.
    """
    if larger:
        both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi")))
        both = both.toDF("node", "other")
    else:
        both = edges.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    if larger:
        kept = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        least = least.select("node", F.least("least", "node").alias("least"))
        return (
            kept.join(least, "node")
            .select(F.col("other").alias("hi"), F.col("least").alias("lo"))
            .distinct()
        )
    tied = both.join(least, "node").where("other != least").select(
        F.col("other").alias("hi"), F.col("least").alias("lo")
    )
    return tied.union(least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1000003)
    ).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is its least node.

    Edges with a null end and loops tie nothing; repeated edges count once.
    Each round is written to the shared folder; rounds grow with the logarithm
    of a component's size.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(
        ends.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    before = _digest(edges)
    while before[0]:
        # a task for so many edges: few edges make their rounds without any shuffle
        edges = edges.coalesce(math.ceil(before[0] / EDGES_PER_TASK))
        edges = written(_star(_star(edges, larger=True), larger=False), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return roots.union(edges.select(F.col("hi"), F.col("lo")))
