"""Quality scores by Bradley-Terry ranking of preference pairs.

A pair says that one labelled document is better than another. The model is a
linear score of text features whose differences explain the pairs by logistic
loss; a quantile of the learnt scores becomes the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import arrays

#: Labelled rows of each class that the model is fitted on, at most about (chosen by hash of the id).
SAMPLE = 4000
#: Score at the threshold.
CUT = 0.3

_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 0x41) & (_BYTES <= 0x5A),  # capitals
    (_BYTES >= 0x61) & (_BYTES <= 0x7A),  # small letters
    (_BYTES >= 0x30) & (_BYTES <= 0x39),  # digits
    _BYTES >= 0x80,  # bytes of other scripts and accents
    (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)),  # white space
    np.isin(_BYTES, [0x2C, 0x2E, 0x3A, 0x3B, 0x3F]),  # , . : ; ?
    np.isin(_BYTES, [0x21]),  # !
    np.isin(_BYTES, [0x22, 0x27, 0x28, 0x29, 0x2D]),  # quotes, brackets, hyphen
    np.isin(_BYTES, [0x7C, 0x2F, 0x5C, 0x3C, 0x3E, 0x3D, 0x5F]),  # | / \ < > = _
    np.isin(_BYTES, [0x23, 0x24, 0x25, 0x26, 0x2A, 0x2B, 0x40, 0x5E, 0x60, 0x7B, 0x7D, 0x7E, 0x5B, 0x5D]),
    _BYTES == 0x0A,  # line ends
])
N_FEATURES = 2 * len(_CLASSES) + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text, from all its bytes and words."""
    n_rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    columns = []
    for accept in _CLASSES:
        counts = np.concatenate([[0], np.cumsum(accept[data])])
        share = (counts[offsets[1:]] - counts[offsets[:-1]]) / np.maximum(size, 1)
        columns += [share, np.sqrt(share)]
    starts, ends, rows = arrays.word_spans(data, offsets, arrays.SPACED)
    words = arrays.range_hashes(arrays.prefix_sums(data), starts, ends)
    n = np.bincount(rows, minlength=n_rows).astype(float)
    some = np.maximum(n, 1)
    lengths = ends - starts
    mean = np.bincount(rows, lengths, minlength=n_rows) / some
    spread = np.sqrt(np.maximum(0, np.bincount(rows, lengths.astype(float) ** 2, minlength=n_rows) / some - mean**2))
    # distinct words and word pairs of each row, and words that repeat the one before
    keyed = arrays.mixed(words + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = _distinct(keyed, rows, n_rows)
    same_row = rows[1:] == rows[:-1]
    pairs = arrays.sequence_hashes(keyed, 2)[same_row]
    two = _distinct(pairs, rows[1:][same_row], n_rows)
    again = np.bincount(rows[1:][same_row & (words[1:] == words[:-1])], minlength=n_rows)
    columns += [
        np.log1p(size), np.log1p(n), mean, spread, distinct / some,
        two / np.maximum(n - 1, 1), again / some, (n == 0).astype(float),
    ]
    return np.stack(columns, axis=1)


def _distinct(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows[first], minlength=n_rows)


def _with_features(texts: DataFrame, keys: list[str]) -> DataFrame:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches):
            rows = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keys), pa.array(list(rows), pa.list_(pa.float64()))],
                [*keys, "features"],
            )

    head = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.mapInArrow(extract, f"{head}, features array<double>")


@dataclass(frozen=True)
class Ranking:
    """A linear score over scaled features, and how scores map to 0..1."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0..1 and increasing in the raw score; CUT at the threshold."""
        z = self.slope * (self.raw(rows) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ranking(
    better: np.ndarray, worse: np.ndarray, share_worse: float, pairs: int = 40_000,
    ridge: float = 3e-4, steps: int = 25, seed: int = 7,
) -> Ranking:
    """Newton steps on the logistic loss of feature differences over drawn preference pairs.

    Without rows of either class nothing can be preferred: every score is 1 or
    0 by what there is, and 1 without labels.
    """
    width = N_FEATURES
    if not len(better) or not len(worse):
        level = 40.0 if len(better) or not len(worse) else -40.0
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), -level, 1.0)
    rows = np.concatenate([better, worse])
    centre, scale = rows.mean(0), rows.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    one, two = (np.clip((x - centre) / scale, -8, 8) for x in (better, worse))
    rng = np.random.default_rng(seed)
    difference = one[rng.integers(len(one), size=pairs)] - two[rng.integers(len(two), size=pairs)]
    weights = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -40, 40)))  # chance of the wrong order
        gradient = -(difference.T @ p) / pairs + ridge * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    # the quantile of scores at which the fewest labels are missed, weighed by class shares
    high, low = np.sort(one @ weights), np.sort(two @ weights)
    levels = np.quantile(np.concatenate([high, low]), np.linspace(0, 1, 1001))
    missed = (1 - share_worse) * np.searchsorted(high, levels) / len(high)
    passed = share_worse * (1 - np.searchsorted(low, levels) / len(low))
    loss = missed + passed
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    threshold = float(levels[best].mean())
    slope = 4.0 / max(float(np.std(np.concatenate([high, low]))), 1e-9)
    return Ranking(centre, scale, weights, threshold, slope)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by ``folds``; null ids are too."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(True))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample: int = SAMPLE,
) -> Ranking:
    """A ranking from labelled rows that are not held out.

    Labels other than 0 and 1, null ids and labels of missing documents teach
    nothing. An id labelled both ways counts as worse. Of each class about
    ``sample`` rows are used, chosen by a hash of the id, so the driver gets
    at most some 2.5 * ``sample`` rows of features.
    """
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.min("label").alias("label"))
    )
    counts = {row["label"]: row["n"] for row in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("label") == label, F.lit(min(1.0, 1.2 * sample / n))).otherwise(chance)
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    chosen = marks.where(draw < chance)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the drawn ids are at most some 2.5 * sample rows, so no text has to move
    rows = _with_features(
        texts.join(F.broadcast(chosen), "id").select("label", "text"), ["label"]
    ).collect()
    by = {label: np.array([r["features"] for r in rows if r["label"] == label]) for label in (0, 1)}
    return fit_ranking(by[1], by[0], counts.get(0, 0) / total if total else 0.0)


def quality_scores(
    docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score, predicted.

    Only the whole text is scored; null counts as empty, and empty texts get a
    score like any other. Equal texts get equal scores.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches):
            values = ranking.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values)], ["id", "score"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(score, f"id {kind}, score double").select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    docs: DataFrame, ranking: Ranking, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that the ranking accepts, with all their columns, in one pass."""
    columns, schema = docs.columns, docs.schema

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches, text_col):
            yield part.filter(pa.array(ranking.score(features(data, offsets)) >= CUT))

    return docs.mapInArrow(accept, schema).select(*columns)
