"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of consecutive item words. The block shift table says
how far the search may jump when the last two words under it end no block of a
window; where it may not jump, the bucket of that block holds the windows to
try, and comparing the words themselves confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import arrays
from corpusmill.llm.shared import written

#: Words of a window, and bytes of items searched for at once (an item is never split).
WINDOW, SET_BYTES = 10, 1 << 20
#: Words that one cursor scans; cursors move side by side.
STRIDE = 256


def item_windows(words: list[bytes], window: int) -> set[bytes]:
    """The windows of an item as words joined by a space; a shorter item is one window."""
    if not words:
        return set()
    last = max(1, len(words) - window + 1)
    return {b" ".join(words[i : i + window]) for i in range(last)}


def words_of(text: str | None) -> list[bytes]:
    data = arrays.LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    starts, ends, _ = arrays.word_spans(data, np.array([0, len(data)]), arrays.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@dataclass
class Patterns:
    """The tables for windows of one length."""

    length: int
    block: int
    keys: np.ndarray  # hashes of the blocks of windows, sorted
    shifts: np.ndarray  # words to move when the block under the cursor has this key
    buckets: dict[int, dict[bytes, list[int]]]  # last block -> window -> items

    @property
    def free(self) -> int:
        """The jump over a block that no window has."""
        return self.length - self.block + 1


def _word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return arrays.range_hashes(
        arrays.prefix_sums(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends
    )


def build_patterns(items: list[tuple[int, str | None]], window: int) -> list[Patterns]:
    """Tables by window length: the full window, and each shorter item's length."""
    by_length: dict[int, dict[bytes, list[int]]] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        for text_window in item_windows(words, window):
            length = min(len(words), window)
            by_length.setdefault(length, {}).setdefault(text_window, []).append(number)
    tables = []
    for length, windows in sorted(by_length.items()):
        block = min(2, length)
        shift: dict[int, int] = {}
        buckets: dict[int, dict[bytes, list[int]]] = {}
        for text_window, numbers in windows.items():
            keys = arrays.sequence_hashes(_word_hashes(text_window.split(b" ")), block).tolist()
            for place, key in enumerate(keys):
                jump = len(keys) - 1 - place
                shift[key] = min(jump, shift.get(key, jump))
            buckets.setdefault(keys[-1], {})[text_window] = numbers
        keys = np.array(sorted(shift), dtype=np.uint64)
        shifts = np.array([shift[k] for k in keys.tolist()], dtype=np.int64)
        tables.append(Patterns(length, block, keys, shifts, buckets))
    return tables


def _stops(table: Patterns, blocks: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Block positions where a window may end; cursors run from first to last, both included."""
    found = []
    at, last = first.copy(), last.copy()
    live = at <= last
    at, last = at[live], last[live]
    while len(at):
        keys = blocks[at]
        place = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
        jump = np.where(table.keys[place] == keys, table.shifts[place], table.free)
        stop = jump == 0
        found.append(at[stop])
        at = at + np.maximum(jump, 1)
        live = at <= last
        at, last = at[live], last[live]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def search(
    data: np.ndarray, offsets: np.ndarray, tables: list[Patterns]
) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """First word of each row (and the end), which words are hit, and the items found per row."""
    data = arrays.LOWER[data]
    starts, ends, rows = arrays.word_spans(data, offsets, arrays.ALNUM)
    n_rows = len(offsets) - 1
    words = arrays.range_hashes(arrays.prefix_sums(data), starts, ends)
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    raw = data.tobytes()
    change = np.zeros(len(words) + 1, dtype=np.int64)
    items: list[set[int]] = [set() for _ in range(n_rows)]
    for table in tables:
        if len(words) < table.length:
            continue
        blocks = arrays.sequence_hashes(words, table.block)
        lead = table.length - table.block  # words of a window before its last block
        low, high = bounds[:-1] + lead, bounds[1:] - table.block
        parts = np.maximum(0, -(-(high - low + 1) // STRIDE))
        row = np.repeat(np.arange(n_rows), parts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = low[row] + step * STRIDE
        last = np.minimum(first + STRIDE - 1, high[row])
        for position in _stops(table, blocks, first, last).tolist():
            begin = position - lead
            spans = range(begin, begin + table.length)
            text = b" ".join([raw[starts[i] : ends[i]] for i in spans])
            numbers = table.buckets[int(blocks[position])].get(text)
            if numbers is not None:
                change[begin] += 1
                change[begin + table.length] -= 1
                items[rows[begin]].update(numbers)
    return bounds, np.cumsum(change[:-1]) > 0, items


def _found(
    texts: DataFrame, keys: list[str], items: list[tuple[str | None, str]], window: int
) -> DataFrame:
    """The keys of each row with n_words, the places of hit words, and the items found."""
    names = [name for name, _ in items]
    tables = texts.sparkSession.sparkContext.broadcast(build_patterns(items, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches):
            bounds, hit, found = search(data, offsets, tables.value)
            columns = [part.column(k) for k in keys] + [
                pa.array(np.diff(bounds), pa.int64()),
                pa.array(
                    [np.flatnonzero(hit[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                    pa.list_(pa.int64()),
                ),
                pa.array([sorted({names[i] for i in row} - {None}) for row in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n_words", "hits", "items"])

    head = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.mapInArrow(scan, f"{head}, n_words long, hits array<long>, items array<string>")


def _item_sets(
    benchmark: DataFrame, item_col: str, item_text: str, set_bytes: int
) -> tuple[int, Callable[[int], list[tuple[str | None, str]]]]:
    """How many sets of items there are, and what fetches one of them."""
    benchmark = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")
    ).where("text IS NOT NULL")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = max(1, -(-2 * total // set_bytes))

    def items(part: int) -> list[tuple[str | None, str]]:
        chosen = benchmark.where(F.pmod(F.xxhash64("item", "text"), F.lit(sets)) == part)
        return [(row["item"], row["text"]) for row in chosen.collect()]

    return sets, items


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Items with a null text or no words
    are no test strings; windows of items with a null id count as hits and in
    no list of items; rows that repeat an item id are one item with the
    windows of both. Whole texts are searched, other columns are not
    read. Tasks get the items in sets of about ``set_bytes``: a larger
    benchmark takes several passes over the documents, united by row.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets, items = _item_sets(benchmark, item_col, item_text, set_bytes)
    if sets == 1:
        found = _found(texts, ["id"], items(0), window)
    else:
        rows = written(texts.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
        passes = [_found(rows, ["row", "id"], items(part), window) for part in range(sets)]
        found = reduce(DataFrame.union, passes).groupBy("row", "id").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """The rows of ``docs`` without any occurrence, with all their columns.

    Each row is decided by its own text, whatever its id is and who shares
    it: in the scanning pass with one set of items, by row number with several.
    """
    sets, items = _item_sets(benchmark, item_col, item_text, set_bytes)
    if sets == 1:
        return _without_hits(docs, text_col, items(0), window)
    rows = written(
        docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")),
        "numbered-rows",
    )
    texts = rows.select("number", F.col("row").getField(text_col).alias("text"))
    passes = [_found(texts, ["number"], items(part), window) for part in range(sets)]
    bad = written(
        reduce(DataFrame.union, passes).where("size(hits) > 0").select("number").distinct(), "contaminated"
    )
    return rows.join(bad, "number", "left_anti").select("row.*")


def _without_hits(docs: DataFrame, text_col: str, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(build_patterns(items, window))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches, text_col):
            _, _, found = search(data, offsets, tables.value)
            yield part.filter(pa.array([not row for row in found], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
