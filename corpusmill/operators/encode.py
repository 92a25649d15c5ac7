"""Encoding a corpus without a shuffle.

Pre-tokens are cut in the JVM and stay in their row. A task takes the distinct
words of each batch apart once, remembers them, and puts the ids together by
position. What travels with a task is the vocabulary of the tokenizer, which
its profile bounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.tokens import MAX_LENGTH, attention_mask, pad, pre_tokens, truncate
from corpusmill.operators import eda
from corpusmill.operators.bpe import Profile, Tokenizer

#: Words that a task remembers the ids of, and about how many words or ids it works on at once.
REMEMBERED, AT_ONCE = 50_000, 200_000


def word_tokenizer(vocab: DataFrame, specials: tuple[str, ...], size: int) -> Tokenizer:
    """Word-level ids as a tokenizer; ``vocab`` has at most ``size`` rows."""
    ids = {row["token"]: row["id"] for row in vocab.limit(size).collect()}
    return Tokenizer(Profile(specials, size, kind="word"), ids)


def bpe_pieces(word: str, tokenizer: Tokenizer, ranks: dict) -> list[str]:
    """Merge the lowest ranked neighbours, leftmost first, until none is left.

    Neighbours wait in a heap, so a long word costs n log n.
    """
    p, last = tokenizer.profile, len(word) - 1
    spelled = [
        ("" if i == 0 else p.prefix) + c + (p.suffix if i == last else "")
        for i, c in enumerate(word)
    ]
    parts: list[str | None] = [s if s in tokenizer.ids else p.unknown for s in spelled]
    right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

    def waiting(i: int) -> tuple | None:
        pair = (parts[i], parts[right[i]]) if right[i] < len(parts) else None
        return (ranks[pair], i, pair) if pair in ranks else None

    heap = [item for item in map(waiting, range(len(parts))) if item]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if parts[i] != pair[0] or j >= len(parts) or parts[j] != pair[1]:
            continue
        parts[i], parts[j] = pair[0] + pair[1].removeprefix(p.prefix), None
        right[i] = right[j]
        if right[i] < len(parts):
            left[right[i]] = i
        for place in (left[i], i):
            if place >= 0 and (item := waiting(place)):
                heapq.heappush(heap, item)
    return [part for part in parts if part is not None]


def wordpiece_pieces(word: str, tokenizer: Tokenizer, longest: int) -> list[str]:
    """Greedy longest match; a word with an unmatched rest is unknown."""
    p, start, parts = tokenizer.profile, 0, []
    if p.max_word_chars is not None and len(word) > p.max_word_chars:
        return [p.unknown]
    while start < len(word):
        mark = p.prefix if start else ""
        ends = range(min(len(word), start + longest), start, -1)
        end = next((e for e in ends if mark + word[start:e] in tokenizer.ids), None)
        if end is None:
            return [p.unknown]
        parts.append(mark + word[start:end])
        start = end
    return parts


def splitter(tokenizer: Tokenizer) -> Callable[[str], list[str]]:
    """The function that takes one word apart."""
    p = tokenizer.profile
    if p.kind == "word":
        return lambda word: [word if word in tokenizer.ids else p.unknown]
    if p.kind == "wordpiece":
        longest = max(map(len, tokenizer.ids), default=1)
        return lambda word: wordpiece_pieces(word, tokenizer, longest)
    ranks = {pair: rank for rank, pair in reversed([*enumerate(tokenizer.merges)])}
    return lambda word: bpe_pieces(word, tokenizer, ranks)


def _slices(batch: pa.RecordBatch, column: str, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists hold about ``at_once`` items together; a longer row stands alone.

    What Python needs for a batch then depends neither on how many rows Spark
    puts into it nor on how long their lists are.
    """
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _spread(values: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[code]`` of each code one after the other, and their sizes."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    each = sizes[codes]
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return flat[np.repeat(starts[codes], each) + place], each


def encode_tokens(rows: DataFrame, tokenizer: Tokenizer, keys: list[str]) -> DataFrame:
    """``keys`` and ``tokens`` to ``input_ids`` and ``unknown`` (a piece is unknown)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, unknown = splitter(tokenizer), tokenizer.profile.unknown
        known: dict[str, tuple[np.ndarray, bool]] = {}
        for batch in chain.from_iterable(_slices(whole, "tokens") for whole in batches):
            lists = batch.column("tokens")
            lists = lists.fill_null([]) if lists.null_count else lists
            words = lists.flatten().dictionary_encode()
            if len(known) > REMEMBERED:
                known.clear()
            values, bad = [], []
            for word in words.dictionary.to_pylist():
                if word not in known:
                    parts = split(word)
                    ids = np.array([tokenizer.ids[t] for t in parts], dtype=np.int32)
                    known[word] = ids, unknown in parts
                values.append(known[word][0])
                bad.append(known[word][1])
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            flat, sizes = _spread(values, codes)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])[bounds]
            misses = np.concatenate([[0], np.cumsum(np.array(bad, dtype=bool)[codes])])[bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keys),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array(np.diff(misses) > 0),
                ],
                [*keys, "input_ids", "unknown"],
            )

    head = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.select(*keys, "tokens").mapInArrow(
        run, f"{head}input_ids array<int>, unknown boolean"
    )


def encode_corpus(df: DataFrame, tokenizer: Tokenizer, key: str = "doc_id") -> DataFrame:
    """``(key, input_ids)`` per document, empty documents included."""
    rows = df.select(key, pre_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))
    return encode_tokens(rows, tokenizer, [key]).drop("unknown")


def decode_corpus(
    encoded: DataFrame, vocab: Tokenizer | DataFrame, key: str = "doc_id", unknown: str = "[UNK]"
) -> DataFrame:
    """Ids back to tokens, joined by spaces in order.

    Every document stays, an empty one as empty text; an id that the
    vocabulary lacks reads as the unknown token. A vocabulary table
    ``(token, id)`` is as large as its tokenizer was configured.
    """
    if isinstance(vocab, Tokenizer):
        unknown, tokens = vocab.profile.unknown, {i: token for token, i in vocab.ids.items()}
    else:
        tokens = {row["id"]: row["token"] for row in vocab.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(_slices(whole, "input_ids") for whole in batches):
            texts = [
                " ".join([tokens.get(i, unknown) for i in ids or []])
                for ids in batch.column("input_ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(texts, pa.string())], [key, "text"]
            )

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "input_ids").mapInArrow(run, f"{key} {kind}, text string")


def model_inputs(
    encoded: DataFrame, pad_id: int, max_length: int = MAX_LENGTH, side: str = "left"
) -> DataFrame:
    """Truncated, padded ids with mask and labels."""
    ids = pad(truncate(F.col("input_ids"), max_length), max_length, pad_id, side)
    padded = encoded.withColumn("input_ids", ids)
    return padded.withColumn(
        "attention_mask", attention_mask(F.col("input_ids"), pad_id)
    ).withColumn("labels", F.col("input_ids"))


def evaluate_tokenizer(df: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Coverage, token counts, unknown rate and fragmentation in one row.

    Each distinct whitespace word is taken apart once and weighted by its
    frequency; lengths of documents come from encoding them in their rows.
    """
    words = eda.word_frequencies(df).select("word", "n", pre_tokens(F.col("word")).alias("tokens"))
    per_word = encode_tokens(words.where("size(tokens) > 0"), tokenizer, ["word", "n"])
    n, unknown = F.col("n"), F.col("unknown")
    stats = per_word.agg(
        F.count(F.lit(1)).alias("u"), F.sum(n).alias("w"),
        F.coalesce(F.sum(F.when(unknown, n)), F.lit(0)).alias("o"),
        F.count_if("unknown").alias("o_distinct"),
        F.coalesce(F.sum(F.when(F.size("input_ids") > 1, n)), F.lit(0)).alias("s"),
    )
    lengths = encode_corpus(df, tokenizer).select(F.size("input_ids").alias("n_tokens"))
    counts = eda.token_count_stats(lengths)
    return stats.withColumn("counts", counts.select(F.struct("*")).scalar()).select(
        F.round((F.col("u") - F.col("o")) / F.col("u"), 6).alias("vocab_coverage"),
        F.round((F.col("u") - F.col("o_distinct")) / F.col("u"), 6).alias(
            "vocab_coverage_distinct"
        ),
        "counts.mean_token_count", "counts.median_token_count",
        F.round(F.col("o") / F.col("w"), 6).alias("oov_rate"),
        F.round(F.col("s") / F.col("w"), 6).alias("subword_fragmentation"),
    )
