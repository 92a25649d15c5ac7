"""Language identification by unigrams over a fixed public vocabulary, all segmentations summed.

Each language gives every piece of the vocabulary a probability, learnt by
expectation maximisation. The probability of a word is the sum over all ways
to cut it into pieces, found by a forward pass; a text is scored by all its
words. Bytes are pieces too, so every text can be cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import arrays

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents of each language that the probabilities are learnt from, about; and at most
#: so many different words of them all, each cut between characters every so many bytes.
SAMPLE, LEARNT_WORDS, LEARNT_BYTES = 200, 200_000, 256
#: Bytes of the longest piece, after a space.
LONGEST = 48
#: Positions after which a forward pass starts a new scale, so that no product of chances underflows.
RESCALE = 16
#: Words whose scores a task remembers.
REMEMBERED = 400_000

LETTERS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_SLOTS = 1 << 20


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a sentencepiece model that can stand in a run of letters after a space; all bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        body = piece.removeprefix(b" ")
        if LETTERS[np.frombuffer(body, np.uint8)].all() and len(piece) <= LONGEST + 1:
            pieces.add(piece)
    return sorted(pieces)


class Lattice:
    """Finds pieces in words: by hash, through a small table that says which hashes cannot be one."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        hashes = arrays.range_hashes(arrays.prefix_sums(data), starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.possible = np.zeros(_SLOTS, dtype=bool)
        self.possible[(self.hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        self.lengths = sorted({len(p) for p in pieces})

    def arcs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """For each end position the pieces that end there: (end, length, words, pieces).

        ``sizes`` falls, so the words that reach a position are the first few.
        """
        sums = arrays.prefix_sums(data)
        for end in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            reach = int(np.searchsorted(-sizes, -end, side="right"))
            stops = starts[:reach] + end
            for length in self.lengths:
                if length > end:
                    break
                hashes = arrays.range_hashes(sums, stops - length, stops)
                maybe = np.flatnonzero(self.possible[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)])
                if not len(maybe):
                    continue
                place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
                same = self.hashes[place] == hashes[maybe]
                yield end, length, maybe[same], self.order[place[same]]

    def log_scores(
        self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chances: np.ndarray
    ) -> np.ndarray:
        """Log probability of each word in each language, all segmentations of the whole word summed.

        Only as many positions as the longest piece has are kept, each with
        the logarithm of its scale, so a word may have any length.
        """
        out = np.empty((len(starts), chances.shape[1]))
        order = np.argsort(-sizes, kind="stable")
        for part in np.array_split(order, -(-len(order) // 20_000)) if len(order) else []:
            size = sizes[part]
            slots = min(self.lengths[-1], int(size[0])) + 1
            forward = np.zeros((slots, len(part), chances.shape[1]))
            scale = np.zeros_like(forward)
            forward[0], now = 1, 0
            for end, length, words, pieces in chain(self.arcs(data, starts[part], size), [(int(size[0]) + 1, 0, None, None)]):
                while now < end:
                    if now:
                        done = slice(np.searchsorted(-size, -now), np.searchsorted(-size, -now, side="right"))
                        out[part[done]] = np.log(forward[now % slots, done]) + scale[now % slots, done]
                        reach = done.stop
                        if now % RESCALE == 0 and reach:
                            _rescale(forward[now % slots, :reach], scale[now % slots, :reach])
                    now += 1
                    if now <= size[0]:
                        forward[now % slots] = 0
                        scale[now % slots] = scale[(now - 1) % slots]
                if words is None:
                    break
                back = (end - length) % slots
                flow = forward[back, words] * chances[pieces]
                if (end - length) // RESCALE != (end - 1) // RESCALE:
                    flow *= np.exp(scale[back, words] - scale[end % slots, words])
                forward[end % slots, words] += flow
        return out

    def expected(
        self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
        counts: np.ndarray, chances: np.ndarray,
    ) -> np.ndarray:
        """Expected uses of each piece in each language, given how often each word occurs there.

        Forward values are scaled as in ``log_scores``; backward values by the
        inverse, so that their products need no scale but between positions.
        """
        uses = np.zeros_like(chances)
        order = np.argsort(-sizes, kind="stable")
        for part in np.array_split(order, -(-len(order) // 5_000)) if len(order) else []:
            size, at = sizes[part], np.arange(len(part))
            arcs = list(self.arcs(data, starts[part], size))
            forward = np.zeros((int(size[0]) + 1, len(part), chances.shape[1]))
            scale = np.zeros_like(forward)
            forward[0], now = 1, 0
            for end, length, words, pieces in arcs:
                while now < end:
                    if now and now % RESCALE == 0:
                        reach = int(np.searchsorted(-size, -now, side="right"))
                        _rescale(forward[now, :reach], scale[now, :reach])
                    now += 1
                    scale[now] = scale[now - 1]
                forward[end, words] += forward[end - length, words] * chances[pieces] * _step(scale, end, length, words)
            backward = np.zeros_like(forward)
            backward[size, at] = counts[part] / forward[size, at]
            for end, length, words, pieces in reversed(arcs):
                # a position's own new scale is not in the arcs that end there
                flow = backward[end, words] * chances[pieces] * np.exp(scale[end - length, words] - scale[end, words])
                backward[end - length, words] += flow
                weight = flow * forward[end - length, words]
                for language in range(chances.shape[1]):
                    uses[:, language] += np.bincount(pieces, weight[:, language], minlength=len(chances))
        return uses


def _rescale(values: np.ndarray, scale: np.ndarray) -> None:
    """Values become 1 (or stay 0), and their scale takes what they were."""
    size = np.where(values > 0, values, 1.0)
    scale += np.log(size)
    values /= size


def _step(scale: np.ndarray, end: int, length: int, words: np.ndarray) -> np.ndarray | float:
    """What turns values of the scale ``length`` positions back into values of the scale before ``end``."""
    if (end - length) // RESCALE == (end - 1) // RESCALE:
        return 1.0
    return np.exp(scale[end - length, words] - scale[end - 1, words])


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of letters."""
    return arrays.word_spans(data, offsets, LETTERS)


def learnt_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray):
    """The runs in parts of at most LEARNT_BYTES, cut between characters."""
    parts = -(-(ends - starts) // (LEARNT_BYTES - 3))
    which = np.repeat(np.arange(len(starts)), parts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = starts[which] + step * (LEARNT_BYTES - 3)
    for _ in range(3):  # forward to the first byte of a character
        within = (first < ends[which]) & (step > 0)
        inner = within & ((data[np.minimum(first, len(data) - 1)] & 0xC0) == 0x80)
        first = first + inner
    after = np.append(first[1:], 0)
    last = np.append(which[1:] != which[:-1], True) if len(which) else np.empty(0, bool)
    return first, np.where(last, ends[which], after), rows[which]


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs copied one after the other, each after a space: bytes, starts, sizes."""
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(which)) - begin[which]
    source = starts[which] + within - 1
    return np.where(within == 0, np.uint8(0x20), data[np.maximum(source, 0)]), begin, sizes


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the pieces, and the probability of each piece in each language."""

    languages: list[str]
    pieces: list[bytes]
    chances: np.ndarray


def held_out(id_col: Column, folds: int = 3) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1; rows with a null id are too."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 1, F.lit(True))


def _word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of lower-cased runs of letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.text_blocks(batches):
            starts, ends, rows = learnt_parts(data, *letter_runs(data, offsets))
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            table = pa.table({"lang": part.column("lang").take(pa.array(rows)), "word": pa.array(words, pa.binary())})
            table = table.group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).to_batches()

    counted = texts.mapInArrow(count, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    vocabulary: str = VOCABULARY, sample: int = SAMPLE, rounds: int = 4,
) -> LanguageModel:
    """Piece probabilities of each language, from rows that are not held out.

    Rows with a null language, null text or null id teach nothing. Of each
    language about ``sample`` documents are used, chosen by a hash of the id.
    The driver gets the words of those and how often each occurs: at most
    LEARNT_WORDS of LEARNT_BYTES each, chosen by a hash of the word.
    """
    learnable = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.lower(F.col(text_col)).alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    per_language = learnable.groupBy("lang").agg(F.count("*").alias("of"))
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    # a row per language, of which the model itself holds a column of numbers on every task
    chosen = learnable.join(F.broadcast(per_language), "lang").where(draw < 1.2 * sample / F.col("of"))
    words = _word_counts(chosen.select("lang", "text"))
    rows = words.orderBy(F.xxhash64("word"), "word", "lang").limit(LEARNT_WORDS).collect()
    pieces = read_pieces(vocabulary)
    languages = sorted({row["lang"] for row in rows})
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    names = {name: i for i, name in enumerate(languages)}
    words = sorted({bytes(row["word"]) for row in rows})
    place = {word: i for i, word in enumerate(words)}
    counts = np.zeros((len(words), len(languages)))
    for row in rows:
        counts[place[bytes(row["word"])], names[row["lang"]]] += row["n"]
    data = np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    starts = np.cumsum(sizes) - sizes
    lattice = Lattice(pieces)
    chances = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    byte = np.array([len(p) == 1 for p in pieces])[:, None] / 256.0
    for _ in range(rounds):
        uses = lattice.expected(data, starts, sizes, counts, chances)
        share = uses / np.maximum(uses.sum(0), 1e-9)
        common = share.mean(1, keepdims=True)
        chances = 0.88 * share + 0.1 * common + 0.02 * byte
    return LanguageModel(languages, pieces, chances)


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, lang_pred, score.

    The score is the posterior of the predicted language under equal priors.
    Null texts and texts without a letter are ``und`` with score 0, as is
    everything where no language was learnt. Ties go to the first language in
    order. Letters are lower-cased; digits and marks do not count. Whole texts
    are scored, other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        many = len(model.languages)
        lattice = Lattice(model.pieces)
        known, known_scores = np.empty(0, np.uint64), np.empty((0, many))
        for part, data, offsets in arrays.text_blocks(batches, block=2 * arrays.BLOCK_BYTES):
            starts, ends, rows = letter_runs(data, offsets)
            hashes = arrays.range_hashes(arrays.prefix_sums(data), starts, ends)
            unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            if len(known) > REMEMBERED:
                known, known_scores = known[:0], known_scores[:0]
            fresh = unique
            if len(known):
                place = np.minimum(np.searchsorted(known, unique), len(known) - 1)
                new = known[place] != unique
                fresh, first = unique[new], first[new]
            scores = lattice.log_scores(*spaced(data, starts[first], ends[first]), model.chances)
            at = np.searchsorted(known, fresh)
            known, known_scores = np.insert(known, at, fresh), np.insert(known_scores, at, scores, axis=0)
            word_scores = known_scores[np.searchsorted(known, unique)][which]
            totals = np.stack(
                [np.bincount(rows, word_scores[:, k], minlength=len(part)) for k in range(many)], axis=1
            ) if many else np.zeros((len(part), 0))
            told = np.array(part.column("letters")) & (many > 0)
            if many:
                best = totals.argmax(1)
                weight = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
                named = [model.languages[i] if ok else "und" for i, ok in zip(best, told, strict=True)]
            else:
                weight, named = np.zeros(len(part)), ["und"] * len(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(named, pa.string()), pa.array(np.where(told, weight, 0.0))],
                ["id", "lang_pred", "score"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(score, f"id {kind}, lang_pred string, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )
