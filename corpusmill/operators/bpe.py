"""Byte-pair training over distributed word counts.

One table holds each distinct word once, as a string of *codes*: one code
point stands for one symbol id. Two neighbouring symbols are then a two
character substring and a merge is ``replace``, both native string work, and
the order of strings is the order of ids. A second table holds how often each
pair occurs; pairs are counted once, and a round only adds the differences
that the words it changed make.

A round takes the leading pairs and cuts each word wherever two neighbours are
not one of them. What is left, the *chains*, are few: words share them. They
are counted where the words are, and come to the driver as distinct chains of
at most ``places_per_round`` places, where the pairs are merged one after
another; see ``train`` for why that is exact. The words then take over what
became of their chains.

The driver keeps the vocabulary and the merges, both bounded by the configured
size, and the chains of one round, bounded by ``places_per_round``.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.operators import vocab as V
from corpusmill.session import cut_lineage


@dataclass(frozen=True)
class Profile:
    """Trainer settings of one tokenizer family.

    A wordpiece word of more than ``max_word_chars`` characters is unknown, as
    in the public model; None sets no limit.
    """

    specials: tuple[str, ...]
    vocab_size: int
    min_frequency: int = 0
    limit_alphabet: int | None = None
    prefix: str = ""
    suffix: str = ""
    unknown: str = "[UNK]"
    kind: str = "bpe"
    max_word_chars: int | None = None


# The five tokenizer profiles.
PROFILES = {
    "bert": Profile(
        ("[CLS]", "[SEP]", "[PAD]", "[MASK]", "[UNK]"), 30522, prefix="##", kind="wordpiece",
        max_word_chars=100,
    ),
    "gpt2": Profile(
        ("[UNK]", "[PAD]", "[MASK]", "[BOS]", "[EOS]"), 50257, min_frequency=2,
        limit_alphabet=1000, prefix="##", suffix="</w>",
    ),
    "mistral": Profile(("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"), 32000),
    "gemma": Profile(("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"), 30522),
    "llama": Profile(("[BOS]", "[EOS]", "[UNK]", "[PAD]"), 50257),
}


@dataclass
class Tokenizer:
    """A trained vocabulary: token to id, and merges in rank order."""

    profile: Profile
    ids: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    rounds: int = 0

    def vocab(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.ids.items()), schemas.VOCAB)

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, left, right) for rank, (left, right) in enumerate(self.merges)]
        return spark.createDataFrame(rows, schemas.MERGES)


WORDS_PER_TASK = 20_000
#: Leading pairs that a round looks at.
PAIRS_SEEN = 65_536

_FIRST_CODE = 0x100
_SURROGATES = range(0xD800, 0xE000)


def _code(token_id: int) -> str:
    point = token_id + _FIRST_CODE
    return chr(point if point < _SURROGATES.start else point + len(_SURROGATES))


def _token_id(code: str) -> int:
    point = ord(code)
    return (point if point < _SURROGATES.start else point - len(_SURROGATES)) - _FIRST_CODE


def _positions(word: Column) -> list[tuple[Column, bool, bool]]:
    """The parts of a word whose characters share a spelling as symbols."""
    n = F.length(word)
    return [
        (F.when(n == 1, word).otherwise(""), True, True),
        (F.when(n > 1, F.substring(word, 1, 1)).otherwise(""), True, False),
        (F.when(n > 2, word.substr(F.lit(2), n - 2)).otherwise(""), False, False),
        (F.when(n > 1, word.substr(n, F.lit(1))).otherwise(""), False, True),
    ]


def _spelled(char: str, first: bool, last: bool, profile: Profile) -> str:
    return ("" if first else profile.prefix) + char + (profile.suffix if last else "")


def _initial_ids(word_counts: DataFrame, profile: Profile) -> tuple[dict[str, int], list[str]]:
    """Specials, then the alphabet, then the positional spellings in use."""
    chars = sorted(row["char"] for row in V.alphabet(word_counts, profile.limit_alphabet).collect())
    tokens = dict.fromkeys((*profile.specials, *chars))
    if profile.prefix or profile.suffix:
        used = None
        for i, (part, _, _) in enumerate(_positions(F.col("word"))):
            rows = word_counts.select(F.lit(i).alias("place"), F.explode(F.split(part, "")).alias("char"))
            used = rows if used is None else used.unionByName(rows)
        places = [(first, last) for _, first, last in _positions(F.lit(""))]
        allowed = set(chars)
        spelled = {
            _spelled(row["char"], *places[row["place"]], profile)
            for row in used.distinct().collect()
            if row["char"] in allowed
        }
        tokens |= dict.fromkeys(sorted(spelled))
    return {token: i for i, token in enumerate(tokens)}, chars


def _encode_words(
    word_counts: DataFrame, ids: dict[str, int], chars: list[str], profile: Profile
) -> DataFrame:
    """Words as code strings; characters outside the alphabet are left out."""
    word = F.col("word")
    if profile.limit_alphabet:
        listed = "".join(f"\\x{{{ord(char):x}}}" for char in chars)
        outside = f"[^{listed}]"
    parts = []
    for part, first, last in _positions(word):
        spelled = [(c, ids.get(_spelled(c, first, last, profile))) for c in chars]
        known = [(c, _code(i)) for c, i in spelled if i is not None]
        if profile.limit_alphabet:
            part = F.regexp_replace(part, outside, "")
        parts.append(
            F.translate(part, "".join(c for c, _ in known), "".join(code for _, code in known))
        )
    coded = word_counts.select(F.concat(*parts).alias("codes"), "freq")
    # A round is one pass over the words: enough of them for each task, and
    # without a shuffle of pairs while they fit one.
    tasks = math.ceil(max(1, word_counts.count()) / WORDS_PER_TASK)
    return coded.groupBy("codes").agg(F.sum("freq").alias("freq")).repartition(tasks)


def _pair_rows(codes: Column, sign: int, words: DataFrame) -> DataFrame:
    places = F.explode(F.sequence(F.lit(1), F.length(codes) - 1)).alias("place")
    long = words.filter(F.length(codes) > 1).select(codes.alias("codes"), "freq", places)
    return long.select(
        F.col("codes").substr(F.col("place"), F.lit(2)).alias("pair"),
        (sign * F.col("freq")).alias("n"), F.lit(sign).cast("long").alias("places"),
    )


def _summed(pairs: DataFrame) -> DataFrame:
    """Occurrences, weighted by word frequency, and places in distinct words of each pair that is left."""
    total = pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
    return total.filter("places > 0")


class _Vocabulary:
    """Tokens in id order and merges in rank order, up to a size."""

    def __init__(self, ids: dict[str, int], size: int, prefix: str) -> None:
        self.ids, self.size, self._prefix = ids, size, prefix
        self._tokens = list(ids)
        self.merges: list[tuple[str, str]] = []

    def full(self) -> bool:
        return len(self.ids) >= self.size

    def merge(self, pair: str) -> tuple[str, bool]:
        """The code of the merged pair, and whether its token is new."""
        left, right = (self._tokens[_token_id(code)] for code in pair)
        token = left + right.removeprefix(self._prefix)
        new = token not in self.ids
        if new:
            self.ids[token] = len(self._tokens)
            self._tokens.append(token)
        self.merges.append((left, right))
        return _code(self.ids[token]), new


def _apart(best: list[tuple[str, int, int]], vocabulary: _Vocabulary, limit: int) -> list[str]:
    """The leading pairs none of which starts with a symbol that another ends with."""
    room = min(limit, vocabulary.size - len(vocabulary.ids))
    chosen, lefts, rights = [], set(), set()
    for pair, _, _ in best[:room]:
        if pair[0] in rights or pair[1] in lefts or chosen and pair[0] == pair[1]:
            break
        chosen.append(pair)
        lefts.add(pair[0])
        rights.add(pair[1])
        if pair[0] == pair[1]:  # what it becomes may be as frequent as any other pair
            break
    return chosen


class _Words:
    """The chains of a round with an index from each pair to its chains, merged one pair at a time."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.before = [codes for codes, _ in words]
        self.codes = list(self.before)
        self._freq = [freq for _, freq in words]
        self.count: dict[str, int] = {}
        self._index: dict[str, set[int]] = {}
        self._queue: list[tuple[int, str]] = []
        for word in range(len(words)):
            self._add(word, 1)

    def _add(self, word: int, sign: int) -> set[str]:
        codes, weight = self.codes[word], sign * self._freq[word]
        pairs = [codes[i : i + 2] for i in range(len(codes) - 1)]
        for pair in pairs:
            self.count[pair] = self.count.get(pair, 0) + weight
            if sign > 0:
                self._index.setdefault(pair, set()).add(word)
        return set(pairs)

    def queue(self, pairs) -> None:
        for pair in pairs:
            heapq.heappush(self._queue, (-self.count.get(pair, 0), pair))

    def best(self) -> tuple[str, int] | None:
        """The most frequent queued pair; the lowest of equal ones."""
        while self._queue:
            n, pair = self._queue[0]
            now = self.count.get(pair, 0)
            if -n == now and now > 0:
                return pair, now
            heapq.heappop(self._queue)
            if now > 0:
                heapq.heappush(self._queue, (-now, pair))
        return None

    def merge(self, pair: str, code: str) -> None:
        made: set[str] = set()
        for word in self._index.pop(pair, ()):
            if pair in self.codes[word]:
                self._add(word, -1)
                self.codes[word] = self.codes[word].replace(pair, code)
                made |= self._add(word, 1)
        self.queue(p for p in made if code in p)

    def changed(self) -> dict[str, str]:
        return {a: b for a, b in zip(self.before, self.codes, strict=True) if a != b}


def _merge_here(
    held: _Words, pairs: list[str], left_out: tuple[int, str] | None, at_least: int, vocabulary: _Vocabulary
) -> None:
    """Merge the best of ``pairs`` and of what they become while it ranks before ``left_out``."""
    held.queue(pairs)
    while not vocabulary.full():
        found = held.best()
        if found is None or found[1] < at_least or left_out and (-found[1], found[0]) >= left_out:
            return
        code, new = vocabulary.merge(found[0])
        held.merge(found[0], code)
        if not new:  # pairs with a symbol that other words hold too are not all here
            return


def _listed(column: pa.Array | pa.ChunkedArray) -> list:
    """Its values; unlike ``to_pylist`` without an object of Arrow for each."""
    return column.to_pandas().tolist()


def _cut(codes: str, pairs: frozenset[str]) -> list[str]:
    """The word in pieces, cut between neighbours that are none of ``pairs``."""
    pieces, start = [], 0
    for i in range(1, len(codes)):
        if codes[i - 1 : i + 1] not in pairs:
            pieces.append(codes[start:i])
            start = i
    pieces.append(codes[start:])
    return pieces


def _chains(words: DataFrame, pairs: frozenset[str]) -> DataFrame:
    """Distinct pieces of two symbols and more, with the frequency of the words that hold them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for codes, freq in zip(_listed(batch["codes"]), _listed(batch["freq"]), strict=True):
                for piece in _cut(codes, pairs):
                    if len(piece) > 1:
                        found[piece] += freq
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["codes", "freq"]
            )

    parts = words.select("codes", "freq").mapInArrow(counted, "codes string, freq long")
    return parts.groupBy("codes").agg(F.sum("freq").alias("freq"))


def _taken_over(words: DataFrame, pairs: frozenset[str], changes: dict[str, str]) -> DataFrame:
    """Adds ``after``: the word with its chains as they became, null where none changed."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = _listed(batch["codes"])
            after = ["".join(changes.get(piece, piece) for piece in _cut(codes, pairs)) for codes in before]
            after = [b if a != b else None for a, b in zip(before, after, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["codes"], batch["freq"], pa.array(after, pa.string())], ["codes", "freq", "after"]
            )

    return words.select("codes", "freq").mapInArrow(applied, "codes string, freq long, after string")


def train(
    word_counts: DataFrame, profile: Profile, vocab_size: int | None = None,
    pairs_per_round: int = 64, places_per_round: int = 400_000, rounds_per_checkpoint: int = 4,
) -> Tokenizer:
    """Merge the best pair until the vocabulary is full.

    A round takes the best pairs in rank order, and the chains of symbols that
    they make in the words. Merges go on, in the order of one merge at a time,
    while the best pair ranks before the first pair left out. No pair across a
    cut gets there: all occurrences of one lie where the same pair was cut at
    the start of the round, as a new symbol begins and ends with the same
    symbols everywhere. So it is at most as frequent as that pair, which ranks
    no better than the one left out, and loses a tie because new symbols have
    the highest ids. All other pairs have all their occurrences in the chains.

    Pairs are taken while their distinct chains have at most
    ``places_per_round`` places; how many that are is tried, from what the
    round before took. At least those are taken, up to ``pairs_per_round``,
    none of which starts with a symbol that another ends with: their
    occurrences cannot overlap, and a new pair ranks below all of them.

    A merge whose token exists already ends its round.
    """
    at_least = max(1, profile.min_frequency)
    word_counts = word_counts.persist()
    ids, chars = _initial_ids(word_counts, profile)
    vocabulary = _Vocabulary(ids, vocab_size or profile.vocab_size, profile.prefix)
    words = cut_lineage(_encode_words(word_counts, ids, chars, profile)).persist()
    word_counts.unpersist()
    counts = _summed(_pair_rows(F.col("codes"), 1, words)).persist()
    rounds, stale, wanted = 0, [(words, counts)], 64
    while not vocabulary.full():
        ranked = counts.filter(F.col("n") >= at_least).orderBy(F.desc("n"), "pair").limit(PAIRS_SEEN)
        best = list(zip(*map(_listed, ranked.toArrow()), strict=True))
        if not best:
            break
        rounds += 1
        apart = _apart(best, vocabulary, pairs_per_round)
        fitting = bisect_right(list(accumulate(places for _, _, places in best)), places_per_round)
        while True:
            taken = max(wanted if places_per_round else 0, fitting)
            whole = taken >= len(best) < PAIRS_SEEN
            taken = len(best) if whole else min(taken, len(best) - 1)
            alone = not whole and taken <= len(apart)
            pairs = apart if alone else [pair for pair, _, _ in best[:taken]]
            chains = _chains(words, frozenset(pairs)).persist()
            places = chains.agg(F.sum(F.length("codes") - 1)).first()[0]
            room = 0.7 * places_per_round / places
            if alone or taken <= fitting or places <= places_per_round:
                break
            chains.unpersist()
            wanted = int(taken * max(0.25, room))
        wanted = max(1, int(len(pairs) * min(4, max(1, room))))
        found = chains.toArrow()
        chains.unpersist()
        held = _Words(list(zip(*map(_listed, found), strict=True)))
        if alone:
            for pair in pairs:
                code, new = vocabulary.merge(pair)
                held.merge(pair, code)
                if not new:
                    break
        else:
            _merge_here(held, pairs, None if whole else (-best[taken][1], best[taken][0]), at_least, vocabulary)
        if vocabulary.full():
            break
        both = _taken_over(words, frozenset(pairs), held.changed()).persist()
        changed = both.filter("after IS NOT NULL")
        differences = _pair_rows(F.col("codes"), -1, changed).unionByName(_pair_rows(F.col("after"), 1, changed))
        counts = _summed(counts.unionByName(differences)).persist()
        words = both.select(F.coalesce("after", "codes").alias("codes"), "freq")
        stale.append((both, counts))
        if rounds % rounds_per_checkpoint == 0:
            words, counts = cut_lineage(words).persist(), cut_lineage(counts).persist()
            stale.append((words, counts))
        while len(stale) > 2:
            for table in stale.pop(0):
                table.unpersist()
    for tables in stale:
        for table in tables:
            table.unpersist()
    return Tokenizer(profile, vocabulary.ids, vocabulary.merges, rounds)
