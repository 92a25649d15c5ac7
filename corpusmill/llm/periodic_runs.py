"""Periodic runs of words from a dictionary of basic factors.

The dictionary names every stretch of 2^k words so that equal stretches have
equal names. A run of period q, 2^k <= q < 2^(k+1), starts with a stretch of
2^k words that comes again q words later, so within twice its length. The
occurrences of a name that follow each other by at most half its length form
an arithmetic progression; differences to the next progressions propose
periods, and the dictionary extends each proposal to its whole run.

Why no run is lost: let u be the first 2^k words of a run from s to e. Within
twice its length u has at most four further progressions, as two of them
overlap by less than their difference. If the stretch of u's own period around
s ends q words or more before e, the last members of the two progressions are
q apart; if the one around s+q begins after s+q, the first ones are; else the
second progression begins at s+q itself. So (any member, first of a next one)
and (last, last of a next one) propose q.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a run.
LEAST = 12
#: Progressions that can follow within twice a factor's length.
_NEXT = 4
#: Text bytes worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def basic_factors(words: np.ndarray) -> list[np.ndarray]:
    """Level k names the 2^k words from each place on; -1 where no other place has them.

    A stretch that is unique stays unique when it grows, so each level only
    names what the level before repeats, and the last level repeats nothing.
    """
    levels: list[np.ndarray] = []
    places, keys = np.arange(len(words)), words.astype(np.int64)
    while len(places):
        _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
        level = np.full(len(words), -1, dtype=np.int32)
        again = counts[names] > 1
        level[places[again]] = names[again]
        levels.append(level)
        half = 1 << (len(levels) - 1)
        places = places[again]
        places = places[places + half < len(words)]
        places = places[level[places + half] >= 0]
        keys = level[places].astype(np.int64) * len(words) + level[places + half]
    return levels


def proposals(level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs of one level, size <= period < 2 * size, one for each stretch of places."""
    places = np.flatnonzero(level >= 0)
    places = places[np.argsort(level[places], kind="stable")]
    names = level[places]
    if not len(places):
        return places, places
    new = np.empty(len(places), dtype=bool)
    new[0] = True
    new[1:] = (names[1:] != names[:-1]) | (2 * np.diff(places) > size)
    progression = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    found = []
    for step in range(1, _NEXT + 1):
        for members, ends in ((np.arange(len(places)), first), (last, last)):
            members = members[progression[members] + step < len(first)]
            target = ends[progression[members] + step]
            period = places[target] - places[members]
            fits = (names[target] == names[members]) & (period >= size) & (period < 2 * size)
            found.append(np.stack([period[fits], places[members][fits]]))
    period, place = np.concatenate(found, axis=1)
    order = np.lexsort((place, period))
    period, place = period[order], place[order]
    # a place right after another of the same period lies in the same run
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (np.diff(period) != 0) | (np.diff(place) > 1)
    return place[fresh], period[fresh]


def _agreement(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray, back: bool) -> np.ndarray:
    """How many words from two places on (or, ``back``, before them) are the same."""
    n = len(levels[0])
    met = np.zeros(len(left), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        shift = -met - size if back else met
        one, two = left + shift, right + shift
        inside = (one >= 0) & (two < n)
        one, two = np.where(inside, one, 0), np.where(inside, two, 0)
        same = inside & (levels[k][one] >= 0) & (levels[k][one] == levels[k][two])
        met += size * same
    return met


def find_runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of ``least`` words and two periods, by start, then period."""
    levels = basic_factors(words)
    found = [np.empty((3, 0), dtype=np.int64)]
    for k, level in enumerate(levels):
        place, period = proposals(level, 1 << k)
        start = place - _agreement(levels, place, place + period, back=True)
        end = place + period + _agreement(levels, place, place + period, back=False)
        whole = end - start >= np.maximum(least, 2 * period)
        found.append(np.stack([start, end, period])[:, whole])
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # the multiples of a run's period are periods of the same stretch
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def planted_places(n: int, h: int | None) -> np.ndarray:
    """Which original word stands at each of n places of the document whose id has the checksum h."""
    places = np.arange(n)
    if h is None or h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _block(texts: list[bytes], checksums: list[int | None]) -> list[tuple]:
    """The result of each text; words of all texts are named together, and differ between texts."""
    split = [text.split() for text in texts]  # at the bytes 20, 09 to 0D
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    named = pa.array([w for words in split for w in words], pa.large_binary()).dictionary_encode()
    names = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    source = [planted_places(n, h) for n, h in zip(sizes.tolist(), checksums, strict=True)]
    rows = np.repeat(np.arange(len(split)), sizes)
    if len(names):
        names = names[np.concatenate(source) + edges[rows]]
    start, end, period = find_runs(names + rows * (len(named.dictionary) + 1))
    first = np.searchsorted(start, edges)

    out = []
    for row, words in enumerate(split):
        some = slice(first[row], first[row + 1])
        s, e, q = start[some] - edges[row], end[some] - edges[row], period[some]
        kept = source[row]
        top = (None,) * 4
        if len(s):
            best = np.lexsort((q, s, s - e))[0]
            length = int(e[best] - s[best])
            top = (int(s[best]), length, int(q[best]), 1000 * length // int(q[best]))
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(cover, s + q, 1)
            np.add.at(cover, e, -1)
            kept = kept[np.cumsum(cover)[:-1] == 0]
        listed = "".join(f"{a},{b - a},{c}\n" for a, b, c in zip(s.tolist(), e.tolist(), q.tolist(), strict=True))
        collapsed = b" ".join([words[i] for i in kept.tolist()])
        out.append((len(s), *top, _digest(listed.encode()), _digest(collapsed), len(words), len(words) - len(kept)))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_runs, the longest run (start, length, period,
    exponent_milli), runs_sha256, collapsed_sha256, n_words, n_dropped.

    Words are stretches without the bytes 20 and 09 to 0D of the whole text.
    Rows whose id's checksum (CRC-32 of its decimal text) is divisible by 10
    get planted repeats first (``planted_places``); null ids get none. A run
    has at least ``LEAST`` words and two of its smallest period, and neither
    neighbour extends it. Words of a run after its first period are dropped
    from the collapsed text. Null and empty texts have no words and no run:
    four nulls, and digests of the empty text. Of equally long runs the first,
    then that of smallest period is reported. Rows that repeat are rows like
    others; other columns are not read. Each row is worked on by itself, so
    nothing is shuffled; a task holds log2(longest repeated stretch) names of
    four bytes per word of a block of texts, or of one longer text.
    """
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.crc32(F.col(id_col).cast("string").cast("binary")).alias("checksum"),
    )
    kind = texts.schema["id"].dataType.simpleString()
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.string() if part.endswith("string") else pa.int64() for part in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("").cast(pa.large_binary())
            checksums = batch.column("checksum").to_pylist()
            begin = 0
            while begin < len(batch):
                held, stop = 0, begin
                some: list[bytes] = []
                while stop < len(batch) and (not some or held < BLOCK_BYTES):
                    some.append(column[stop].as_py())
                    held += len(some[-1])
                    stop += 1
                found = _block(some, checksums[begin:stop])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, stop - begin)]
                    + [pa.array(values, t) for values, t in zip(zip(*found, strict=True), types, strict=True)],
                    ["id", *names],
                )
                begin = stop

    return texts.mapInArrow(scan, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
