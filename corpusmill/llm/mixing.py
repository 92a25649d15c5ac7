"""Temperature mixing of sources, realised as budgeted block permutations.

Source weights are token shares raised to an exponent and normalised. The
exponent is bisected until the weights meet a target entropy or no source
repeats too often. Each source is then read in passes over its blocks in a
seeded order, until its part of the token budget is spent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import arrays
from corpusmill.llm.shared import written

#: Tokens of a block, about, and most blocks of a source (larger sources have larger blocks).
BLOCK_TOKENS, MAX_BLOCKS = 50_000, 4096
#: Halvings of the exponent's bracket that one pass over the sources serves.
LEVELS = 5


def _token_counts(rows: DataFrame) -> DataFrame:
    """Adds tokens: words between white space; null has none. The text stays behind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches):
            _, _, row = arrays.word_spans(data, offsets, arrays.SPACED)
            tokens = np.bincount(row, minlength=len(part))
            yield pa.RecordBatch.from_arrays(
                [part.column(k) for k in kept] + [pa.array(tokens, pa.int64())], [*kept, "tokens"]
            )

    kept = [c for c in rows.columns if c != "text"]
    head = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    return rows.mapInArrow(count, f"{head}, tokens long")


def _at(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """Entropy of the weights and the largest repetition, at each exponent, in one aggregation."""
    total = F.lit(float(sources.agg(F.sum("tokens")).first()[0]))
    share = F.col("tokens") / total
    columns = []
    for i, a in enumerate(exponents):
        power = F.pow(share, F.lit(a))
        columns += [
            F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share) * a).alias(f"s{i}"),
            F.max(power / F.col("tokens")).alias(f"r{i}"),
        ]
    row = sources.agg(*columns).first()
    out = []
    for i in range(len(exponents)):
        z = row[f"z{i}"]
        out.append((math.log(z) - row[f"s{i}"] / z, budget * row[f"r{i}"] / z))
    return out


def find_exponent(
    sources: DataFrame, budget: float, entropy: float | None = None,
    max_repeats: float | None = None, passes: int = 6,
) -> float:
    """The exponent in 0..1 whose weights meet the target.

    ``sources`` has tokens > 0 per source. Entropy falls with the exponent:
    the largest one with at least the target entropy is taken. Repetition of
    small sources falls with it too: the smallest one within the limit is
    taken; with both targets, the limit on repeats decides where they clash.
    A target out of reach gives the nearest end. Each pass looks at all the
    points that the next LEVELS halvings could visit.
    """
    def bisect(good_high: bool, good) -> float:
        low, high = 0.0, 1.0
        ends = _at(sources, [low, high], budget)
        if good(ends[0 if good_high else 1]):
            return low if good_high else high
        if not good(ends[1 if good_high else 0]):
            return high if good_high else low
        for _ in range(passes):
            points = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS)]
            known = dict(zip(points, _at(sources, points, budget), strict=True))
            for _ in range(LEVELS):
                middle = min(known, key=lambda p: abs(p - (low + high) / 2))
                if good(known[middle]) == good_high:
                    high = middle
                else:
                    low = middle
        return high if good_high else low

    exponent = 1.0
    if entropy is not None:
        exponent = bisect(False, lambda at: at[0] >= entropy)
    if max_repeats is not None:
        least = bisect(True, lambda at: at[1] <= max_repeats)
        exponent = max(exponent, least) if entropy is not None else least
    return exponent


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    budget: int | None = None, entropy_share: float | None = None,
    max_repeats: float | None = 2.0, seed: int = 0, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per drawn copy: the id, source, tokens, epoch, turn, place, weight.

    A source gets ``budget`` times its weight in tokens (the budget is all
    tokens unless given). Passes over a source ("epochs") order its blocks by
    a seeded hash (``turn``), and the rows of a block by another (``place``);
    the last pass ends before the row that would exceed the source's part, so
    a source falls short of it by less than one row. ``entropy_share`` asks for that share of the
    largest possible entropy. Null is a source of its own. Rows without words
    (null and empty texts among them) cost nothing and come with every pass
    that reaches their block; a source without any words is not drawn from.
    Rows that repeat both id and text share their place, and are drawn
    together or cut where the sum of all of them would exceed the part. Other columns are not read. An empty
    table, or one without words, gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    ).withColumn("twin", F.xxhash64("id", "text"))
    rows = written(_token_counts(rows), "token-counts")
    sources = written(
        rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources"
    )
    facts = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    total = float(facts["tokens"] or 1)
    budget = total if budget is None else float(budget)
    exponent, norm = 1.0, 1.0
    if facts["n"]:
        entropy = None if entropy_share is None else entropy_share * math.log(facts["n"])
        exponent = find_exponent(sources, budget, entropy, max_repeats)
        norm = sources.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(exponent)))).first()[0]
    weight = F.pow(F.col("tokens") / total, F.lit(exponent)) / norm
    # the part of each source: whole passes, and what is left for the last one
    part = F.floor(F.col("weight") * budget + 1e-6).cast("long")
    parts = sources.select("source", F.col("tokens").alias("size"), weight.alias("weight")).select(
        "source", "weight",
        F.floor(part / F.col("size")).cast("int").alias("whole"),
        (part % F.col("size")).alias("rest"),
        F.least(F.ceil(F.col("size") / block_tokens), F.lit(MAX_BLOCKS)).alias("n_blocks"),
    )
    placed = rows.alias("d").join(parts.alias("p"), F.expr("d.source <=> p.source")).select(
        "d.id", "d.source", "d.tokens", "d.twin", "p.weight", "p.whole", "p.rest",
        F.pmod(F.xxhash64("d.twin", F.lit(seed)), F.col("p.n_blocks")).alias("block"),
    )
    placed = written(placed, "placed")
    in_pass = Window.partitionBy("source", "epoch").orderBy("key", "block")
    blocks = (
        placed.groupBy("source", "block")
        .agg(F.sum("tokens").alias("tokens"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .withColumn("key", F.xxhash64("source", "block", "epoch", F.lit(seed)))
        .select(
            "source", "block", "epoch", F.row_number().over(in_pass).alias("turn"), "tokens",
            F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(
                F.col("rest") - F.sum("tokens").over(in_pass) + F.col("tokens")
            ).alias("left"),
        )
        .where("left > 0")
    )
    copies = placed.alias("d").join(
        blocks.alias("b"), F.expr("d.source <=> b.source AND d.block = b.block")
    ).select(
        "d.id", "d.source", "d.tokens", "d.twin", "d.weight", "b.epoch", "b.turn",
        F.xxhash64("d.twin", "b.epoch", F.lit(seed)).alias("place"),
        "b.left", (F.col("b.left") >= F.col("b.tokens")).alias("entire"),
    )
    # one block of a source is cut: its rows up to what is left
    running = Window.partitionBy("source", "epoch", "turn").orderBy("place", "id")
    cut = copies.where("NOT entire").withColumn("sum", F.sum("tokens").over(running)).where("sum <= left")
    columns = ["id", "source", "tokens", "epoch", "turn", "place", "weight"]
    out = copies.where("entire").select(*columns).union(cut.select(*columns))
    return out.withColumnsRenamed({"id": id_col, "source": source_col})
