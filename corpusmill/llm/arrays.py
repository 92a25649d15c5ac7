"""Word arrays over the UTF-8 bytes of Arrow text columns, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _byte_table(accept: Callable[[int], bool]) -> np.ndarray:
    return np.array([accept(b) for b in range(256)])


#: Bytes of words between white space, and of words of letters and digits (A-Z lower-cased first).
SPACED = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", block: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their texts and the offsets; null is empty."""
    for batch in batches:
        texts = batch.column(column).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
        row = 0
        while row < len(texts):
            stop = int(np.searchsorted(offsets, offsets[row] + block, side="right")) - 1
            stop = min(max(stop, row + 1), len(texts))
            part = offsets[row : stop + 1]
            yield batch.slice(row, stop - row), data[part[0] : part[-1]], part - part[0]
            row = stop


def word_spans(
    data: np.ndarray, offsets: np.ndarray, accept: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of accepted bytes within a row."""
    inside = accept[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any byte range follows."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes anywhere."""
    down = _power("down", _INVERSE, len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of so many consecutive word hashes."""
    n = max(0, len(words) - length + 1)
    out = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        out = mixed(out * _BASE + words[k : k + n])
    return out
