"""What each filter of a chain removes, in every order of the filters.

Each document fails some of the filters: its failure mask. The masks of a part
are counted, and the counts become a decision diagram: one level per filter,
passing to the left, failing to the right, equal sub-diagrams stored once,
each node weighed by the documents below it. Swapping two adjacent levels
turns the diagram of one filter order into that of another, and a walk of such
swaps meets all orders. On a diagram, the path on which all filters pass shows
what every step keeps and removes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import written

FILTERS = "ABCDE"
#: A: fewer words. B: percent of distinct words below. C: percent of capitals above.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Spaces between words, capitals, and the signs of D.
_SPACE, _SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Weight = tuple[int, ...]


class Diagram:
    """A weighed decision diagram over failure masks, whose levels can change places.

    ``counts`` maps a mask (bit i: fails filter i) to a tuple of counts. All
    paths have one node per level, so that a node's weight is the sum of its
    two branches; the leaf of no documents stands for all missing masks.
    """

    def __init__(self, counts: dict[int, Weight], n: int) -> None:
        self.n = n
        self.order = list(range(n))
        self._made: dict[tuple, int] = {}
        self._passing: list[int] = []
        self._failing: list[int] = []
        self.weight: list[Weight] = []
        self._width = len(next(iter(counts.values()), ()))
        self.root = self._built(counts, 0, 0)

    def _leaf(self, weight: Weight) -> int:
        return self._kept(("leaf", weight), -1, -1, weight)

    def _node(self, filter_: int, passing: int, failing: int) -> int:
        weight = tuple(a + b for a, b in zip(self.weight[passing], self.weight[failing], strict=True))
        return self._kept((filter_, passing, failing), passing, failing, weight)

    def _kept(self, key: tuple, passing: int, failing: int, weight: Weight) -> int:
        node = self._made.get(key)
        if node is None:
            node = self._made[key] = len(self.weight)
            self._passing.append(passing)
            self._failing.append(failing)
            self.weight.append(weight)
        return node

    def _built(self, counts: dict[int, Weight], level: int, mask: int) -> int:
        if level == self.n:
            return self._leaf(counts.get(mask, (0,) * self._width))
        return self._node(
            level, self._built(counts, level + 1, mask), self._built(counts, level + 1, mask | 1 << level)
        )

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next one; nodes further below stay."""
        upper, lower = self.order[level], self.order[level + 1]
        turned: dict[int, int] = {}

        def exchanged(node: int, at: int) -> int:
            if node not in turned:
                one, two = self._passing[node], self._failing[node]
                if at < level:
                    turned[node] = self._node(self.order[at], exchanged(one, at + 1), exchanged(two, at + 1))
                else:
                    turned[node] = self._node(
                        lower,
                        self._node(upper, self._passing[one], self._passing[two]),
                        self._node(upper, self._failing[one], self._failing[two]),
                    )
            return turned[node]

        self.root = exchanged(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """(filter, weight kept, weight removed) along the path on which all filters pass."""
        out, node = [], self.root
        for filter_ in self.order:
            out.append((filter_, self.weight[self._passing[node]], self.weight[self._failing[node]]))
            node = self._passing[node]
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after another, so that each order of n filters is met once."""
    places, towards = list(range(n)), [-1] * n
    while True:
        for item in range(n - 1, -1, -1):
            at = places.index(item)
            to = at + towards[item]
            if 0 <= to < n and places[to] < item:
                break
        else:
            return
        places[at], places[to] = places[to], places[at]
        for larger in range(item + 1, n):
            towards[larger] = -towards[larger]
        yield min(at, to)


def audited(counts: dict[int, Weight], names: str = FILTERS) -> list[tuple]:
    """Rows (filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of all orders, by order; weights are (documents, good, toxic).
    """
    n = len(names)
    diagram = Diagram(counts, n)
    orders: dict[tuple[int, ...], list[tuple[int, Weight, Weight]]] = {}
    orders[tuple(diagram.order)] = diagram.steps()
    for level in adjacent_swaps(n):
        diagram.swap(level)
        orders[tuple(diagram.order)] = diagram.steps()
    assert len(orders) == factorial(n)
    fails, unique, shapley = [0] * n, [0] * n, [0] * n
    for steps in orders.values():
        fails[steps[0][0]] = steps[0][2][0]  # first of its order: all that fail it
        unique[steps[-1][0]] = steps[-1][2][0]  # last: all that pass the others
        for filter_, _, removed in steps:
            shapley[filter_] += removed[0]
    return [
        ("".join(names[f] for f in order), step, names[f], kept[0], removed[0], fails[f] - removed[0],
         unique[f], removed[1], removed[2], shapley[f])
        for order in permutations(range(n))
        for step, (f, kept, removed) in enumerate(orders[order], 1)
    ]


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def own_failures(text: Column) -> Column:
    """Mask of the filters A to D, which a text fails or passes by itself."""

    def by_words(words: Column) -> Column:
        return _once(
            F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct")),
            lambda w: F.when(w["n"] < LEAST_WORDS, 1).otherwise(0)
            + F.when(F.lit(100) * w["distinct"] < F.lit(LEAST_DISTINCT) * w["n"], 2).otherwise(0),
        )

    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return (
        _once(F.array_remove(F.split(text, _SPACE), ""), by_words)
        + F.when(F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS) * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(_SIGNS), 8).otherwise(0)
    )


def failure_masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: id, part, mask.

    E looks at the whole table: a row fails it if its text is that of a
    smaller id. Rows with a null id fail and cause no failure of E; of a
    repeated smallest id no row fails. Bodies are read once and never moved:
    what is shuffled is a digest, and only texts that occur twice or more are
    joined back, by a join that splits a group of any size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"),
            F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        ).select(
            "id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("mask")
        ),
        "failure-masks",
    )
    # written, so that the join's partitions are plain ones, of which large ones can be split
    first = written(
        rows.where("id IS NOT NULL").groupBy("digest")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last").select("digest", "first"),
        "first-of-equal-texts",
    )
    return rows.join(first, "digest", "left").select(
        "id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("mask")
    )


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per part with its counted masks: an array of at most 2^5 (mask, n, good, toxic)."""
    marks = (
        labels.select(
            F.col(id_col).alias("id"),
            F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"),
            F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"),
        )
        .where("id IS NOT NULL AND good + toxic > 0")
        .groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    return (
        masks.join(marks, "id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
        .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    )


SCHEMA = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the five filters and step; zeros are rows too.

    Columns: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley, all counts of documents of
    the part. Null texts count as empty (no word: they fail A alone, or A and
    E); a null part is the empty string. A label row counts as good where
    quality is 1 and as toxic where toxic is 1; of an id with several label
    rows one that says so is enough, and null ids have no label. Rows that
    repeat count as often as they are there. Without documents there is no
    part and no row. Other columns are not read. Documents are counted by
    (part, mask) before anything is shuffled by part, so a part of any size
    is 32 rows to its diagram.
    """
    counted = mask_counts(failure_masks(docs, id_col, text_col, part_col), labels, id_col)

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                rows = audited({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), *(
                        pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), (
                            pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7
                        ), strict=True)
                    )],
                    [item.split()[0] for item in SCHEMA.split(", ")],
                )

    return counted.mapInArrow(audit, SCHEMA)
