"""Personal data by four patterns and a semi-Markov conditional random field.

The patterns fix the base spans. The field looks at what they leave: stretches
of digits or of words around an at sign that may hold an entity in another
form (a phone number without a plus, an address spelt with "at" and "dot").
Every candidate segment of such a stretch is scored by features of the whole
span, and a dynamic program over segments of bounded length chooses boundaries
and types together. Outside those stretches no segment can be an entity, so
the program needs no token of them.

The field is fitted on base spans of a bounded sample of rows, rewritten into
other forms, in the words that stand around them, and on look-alikes such as
dates, versions and numbers whose check digit fails.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Most tokens and most groups of digits of a segment.
LONGEST, GROUPS = 24, 7
#: Rows that examples are drawn from, spans of a row, and characters of context.
SAMPLE, PER_ROW, CONTEXT = 4000, 8, 24
#: Text bytes whose stretches are decoded together.
BLOCK_CHARS = 1 << 20

_LOCAL = "A-Za-z0-9._%+-"
_ADDRESS = rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
# Each pattern starts only where an earlier start could not have matched, so a scan is linear.
_EMAIL = re.compile(rf"(?<![{_LOCAL}]){_ADDRESS}")
_EMAIL_HERE = re.compile(_ADDRESS)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the leftmost non-overlapping matches of each pattern that pass its test, sorted."""
    out: list[Span] = []
    if "@" in text:
        match = _EMAIL.search(text)
        while match:
            out.append((match.start(), 0, match.end()))
            # what follows a match may start an address inside the same run of characters
            match = _EMAIL_HERE.match(text, match.end()) or _EMAIL.search(text, match.end())
    for match in _IP.finditer(text):
        if all(map(_byte_sized, match[0].split("."))):
            out.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match[0])
        if len(digits) <= 19 and passes_luhn(digits):
            out.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_digits(match[0])) <= 15:
                out.append((match.start(), 3, match.end()))
    return sorted(out)


# --- candidate segments -------------------------------------------------------------------------

_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/\[\]]{0,4}+[0-9]){6,}+")
_BRACKET_AT = re.compile(r"[\[({] ?(?:[Aa][Tt]|@) ?[\])}]")
_DOT = r"(?:\.| ?[\[({] ?(?:[Dd][Oo][Tt]|\.) ?[\])}] ?| [Dd][Oo][Tt] )"
_DOMAIN = re.compile(rf" ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{1,5}}")
_BEFORE = re.compile(rf"(?:[{_LOCAL}]+{_DOT}){{0,2}}[{_LOCAL}]+ ?$")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
_LETTERS_DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _at_marks(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        yield at, at + 1
        at = text.find("@", at + 1)
    for match in _BRACKET_AT.finditer(text):
        yield match.span()
    if " dot " in text or " DOT " in text:
        for match in re.finditer(r" (?:at|AT) ", text):
            yield match.span()


def stretches(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Character ranges that may hold further entities: none overlaps another or a taken span."""
    found = [match.span() for match in _NUMBERS.finditer(text)]
    for start, end in _at_marks(text):
        after = _DOMAIN.match(text, end)
        before = _BEFORE.search(text, max(0, start - 80), start) if after else None
        if before:
            found.append((before.start(), after.end()))
    blocked, free, place = _united([(s, e) for s, _, e in taken]), [], 0
    for start, end in _united(found):
        while place < len(blocked) and blocked[place][1] <= start:
            place += 1
        at = place
        while at < len(blocked) and blocked[at][0] < end:
            if blocked[at][0] > start:
                free.append((start, blocked[at][0]))
            start = blocked[at][1]
            at += 1
        if start < end:
            free.append((start, end))
    return free


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def segments(text: str, start: int, end: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Number of tokens of a stretch and its candidates (first token, end token, kind, start, end).

    A candidate has at most ``LONGEST`` tokens, does not split a word or a
    number, and is a run of 7 to 19 digits in at most ``GROUPS`` groups, or words around one at
    sign with a dot behind it. What does not look so cannot be an entity.
    """
    tokens = [match.span() for match in _TOKEN.finditer(text, start, end)]
    words = [text[a:b] for a, b in tokens]
    out = []
    for i, (a, _) in enumerate(tokens):
        if a and text[a - 1] in _LETTERS_DIGITS and words[i][0] in _LETTERS_DIGITS:
            continue
        number = words[i][0] in "+(" or words[i].isdigit()
        if not number and words[i][0] not in _LETTERS_DIGITS:
            continue
        digits, groups, marks, dots = 0, 0, 0, 0
        for j in range(i, min(i + LONGEST, len(tokens))):
            word, b = words[j], tokens[j][1]
            alpha = word[0] in _LETTERS_DIGITS
            if word.isdigit():
                digits, groups = digits + len(word), groups + 1
            elif alpha:
                number = False
            marks += word == "@" or word in ("at", "AT", "At") and j > i
            dots += marks > 0 and word in (".", "dot", "DOT", "Dot")
            if marks > 1 or groups > GROUPS and not marks or (not number and words[i][0] in "+("):
                break
            if not alpha or b < len(text) and text[b] in _LETTERS_DIGITS:
                continue
            if number and 7 <= digits <= 19:
                if groups == 4:
                    out.append((i, j + 1, 1, a, b))
                if digits >= 13:
                    out.append((i, j + 1, 2, a, b))
                if digits <= 15:
                    out.append((i, j + 1, 3, a, b))
            if marks == 1 and dots and word not in ("dot", "DOT", "Dot"):
                out.append((i, j + 1, 0, a, b))
    return len(tokens), out


def _size(n: int) -> str:
    return str(n) if n < 4 else "4-7" if n < 8 else "8-15" if n < 16 else "16+"


def features(text: str, kind: int, start: int, end: int) -> list[str]:
    """Names of the features of a whole span of a kind, and of what stands next to it."""
    span, head = text[start:end], KINDS[kind][0]
    before = _WORD_BEFORE.search(text, max(0, start - 20), start)
    left, right = text[start - 1 : start], text[end : end + 1]
    out = [
        "",
        f"word {before[1].lower() if before else ''}",
        f"left {'_' if not left.strip() else left}",
        f"right {'_' if not right.strip() else right}",
    ]
    if kind == 0:
        lower = span.lower()
        mark = re.search(r" ?(?:@|[\[({] ?(?:at|@) ?[\])}]|\bat\b) ?", lower)
        if mark is None:
            return [f"{head} {name}" for name in [*out, "no mark"]]
        name, domain = lower[: mark.start()], lower[mark.end() :]
        labels = re.split(_DOT, domain)
        out += [
            f"mark {mark[0]}", f"labels {_size(len(labels))}", f"last {_size(len(labels[-1]))} {labels[-1].isalpha()}",
            f"spelt {' dot ' in domain} {bool(re.search(r'[({[]', domain))}", f"name {_size(len(name))}",
            f"spaces {' ' in name.strip()} {len(domain.split())}", f"no label {not all(labels)}",
        ]
    else:
        groups = re.findall(r"[0-9]+", span)
        digits = "".join(groups)
        between = re.split(r"[0-9]+", span)[1:-1]
        out += [
            f"shape {'-'.join(str(len(g)) for g in groups[:6])}", f"n {len(digits)}", f"groups {_size(len(groups))}",
            f"between {'|'.join(sorted(set(between)))}", f"head {re.match(r'[+(]*', span)[0]}",
            f"luhn {len(digits) >= 13 and passes_luhn(digits)}", f"one mark {len(set(between)) < 2}",
            f"bytes {len(groups) == 4 and all(map(_byte_sized, groups))}", f"even {len({len(g) for g in groups}) == 1}",
            f"zero {digits[0] == '0'}", f"open {span.count('(') - span.count(')')}",
        ]
    return [f"{head} {name}" for name in out]


# --- the field ------------------------------------------------------------------------------------


class Lattice:
    """All segmentations of a batch of stretches as one graph.

    Nodes are the places between tokens, edges are segments: each token alone
    as outside (label 0), and each candidate with its kind plus one. The
    programs go through all stretches at once, place by place.
    """

    def __init__(self) -> None:
        self.first: list[int] = []
        self.last: list[int] = []
        self.nodes = 0
        self._edges: list[tuple[int, int, int, int, int]] = []  # from, to, label, stretch, candidate

    def add(self, n_tokens: int, candidates: list[tuple[int, int, int, int, int]], base: int) -> None:
        """A stretch; ``base`` is the number of its first candidate."""
        stretch, at = len(self.first), self.nodes
        self._edges += [(at + i, at + i + 1, 0, stretch, -1) for i in range(n_tokens)]
        self._edges += [(at + c[0], at + c[1], c[2] + 1, stretch, base + k) for k, c in enumerate(candidates)]
        self.first.append(at)
        self.last.append(at + n_tokens)
        self.nodes += n_tokens + 1

    def close(self) -> None:
        self.first, self.last = np.array(self.first, dtype=np.int64), np.array(self.last, dtype=np.int64)
        edges = np.array(self._edges, dtype=np.int64).reshape(-1, 5)
        self._edges = []
        end = edges[:, 1] - self.first[edges[:, 3]] if len(edges) else edges[:, 1]
        edges = edges[np.argsort(end, kind="stable")]
        self.start, self.end, self.label, self.stretch, self.candidate = edges.T
        self.inside = self.candidate >= 0
        begins, ends = (x - self.first[self.stretch] if len(edges) else x for x in (self.start, self.end))
        self.by_end = self._levels(np.argsort(ends, kind="stable"), ends)
        self.by_start = self._levels(np.argsort(-begins, kind="stable"), -begins)

    @staticmethod
    def _levels(order: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
        return np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if len(order) else []

    def _scores(self, scores: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start))
        out[self.inside] = scores[self.candidate[self.inside]]
        return out

    def _empty(self) -> np.ndarray:
        table = np.full((self.nodes, len(KINDS) + 1), -np.inf)
        table[self.first, 0] = 0.0
        return table

    def posterior(self, scores: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sum of all segmentations per stretch, chance of each candidate, expected uses of ``follow``."""
        score = self._scores(scores)
        ahead = self._empty()
        behind = np.full_like(ahead, -np.inf)
        behind[self.last] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for e in self.by_end:
                came = np.logaddexp.reduce(ahead[self.start[e]] + follow[:, self.label[e]].T, axis=1)
                np.logaddexp.at(ahead, (self.end[e], self.label[e]), came + score[e])
            for e in self.by_start:
                goes = score[e] + behind[self.end[e], self.label[e]]
                np.logaddexp.at(behind, self.start[e], follow[:, self.label[e]].T + goes[:, None])
            total = np.logaddexp.reduce(ahead[self.last], axis=1)
            used = np.exp(
                ahead[self.start] + follow[:, self.label].T
                + (score + behind[self.end, self.label] - total[self.stretch])[:, None]
            )
        uses = np.zeros_like(follow)
        np.add.at(uses.T, self.label, used)
        chance = np.zeros(len(scores))
        chance[self.candidate[self.inside]] = used.sum(1)[self.inside]
        return total, chance, uses

    def best(self, scores: np.ndarray, follow: np.ndarray) -> list[list[int]]:
        """The candidates of the best segmentation of each stretch; of equal ones, the one found last."""
        score = self._scores(scores)
        most = self._empty()
        edge = np.full(most.shape, -1, dtype=np.int64)
        came = np.zeros(most.shape, dtype=np.int64)
        for e in self.by_end:
            paths = most[self.start[e]] + follow[:, self.label[e]].T
            from_ = paths.argmax(axis=1)
            value = paths.max(axis=1) + score[e]
            np.maximum.at(most, (self.end[e], self.label[e]), value)
            hit = (value == most[self.end[e], self.label[e]]) & np.isfinite(value)
            edge[self.end[e][hit], self.label[e][hit]] = e[hit]
            came[self.end[e][hit], self.label[e][hit]] = from_[hit]
        out = []
        for first, last in zip(self.first.tolist(), self.last.tolist(), strict=True):
            chosen, node, label = [], last, int(most[last].argmax())
            while node > first:
                e = edge[node, label]
                if self.candidate[e] >= 0:
                    chosen.append(int(self.candidate[e]))
                node, label = int(self.start[e]), int(came[node, label])
            out.append(chosen[::-1])
        return out


@dataclass(frozen=True)
class Field:
    """Weights of named features, and of a label following another one (outside, then KINDS)."""

    weights: dict[str, float]
    follow: np.ndarray

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(name, 0.0) for name in names)

    def spans(self, texts: list[str], taken: list[list[Span]]) -> list[list[Span]]:
        """Further spans of each text; none overlaps another or a taken one."""
        lattice, found, scores = Lattice(), [], []
        for row, (text, spans) in enumerate(zip(texts, taken, strict=True)):
            for start, end in stretches(text, spans):
                n, candidates = segments(text, start, end)
                if candidates:
                    lattice.add(n, candidates, len(found))
                    found += [(row, s, kind, e) for _, _, kind, s, e in candidates]
                    scores += [self.score(features(text, kind, s, e)) for _, _, kind, s, e in candidates]
        out: list[list[Span]] = [[] for _ in texts]
        if found:
            lattice.close()
            for chosen in lattice.best(np.array(scores), self.follow):
                for candidate in chosen:
                    row, *span = found[candidate]
                    out[row].append(tuple(span))
        return out


Example = tuple[str, list[Span]]  # a text and all its entities


def fit(examples: list[Example], ridge: float = 0.02, steps: int = 80, rate: float = 0.3) -> Field:
    """Field of the largest penalised likelihood of the examples' segmentations (adaptive gradient steps).

    An example teaches by the stretches whose entities are candidates.
    """
    lattice, index = Lattice(), {}
    gold, gold_follow, rows, columns = [], np.zeros((len(KINDS) + 1,) * 2), [], []
    for text, spans in examples:
        for start, end in stretches(text, []):
            n, candidates = segments(text, start, end)
            want = {(s, k, e) for s, k, e in spans if start <= s and e <= end}
            if not candidates or len(want) != sum((s, k, e) in want for _, _, k, s, e in candidates):
                continue
            base = len(gold)
            lattice.add(n, candidates, base)
            path = {}
            for i, j, kind, s, e in candidates:
                gold.append((s, kind, e) in want)
                if gold[-1]:
                    path[i] = (j, kind + 1)
                names = features(text, kind, s, e)
                columns += [index.setdefault(name, len(index)) for name in names]
                rows += [len(gold) - 1] * len(names)
            node, label = 0, 0
            while node < n:
                node, after = path.get(node, (node + 1, 0))
                gold_follow[label, after] += 1
                label = after
    follow = np.zeros_like(gold_follow)
    if not gold:
        return Field({}, follow)
    lattice.close()
    rows, columns, gold = np.array(rows), np.array(columns), np.array(gold, dtype=float)
    weights, n = np.zeros(len(index)), len(lattice.first)
    past, past_follow = np.full(len(index), 1e-8), np.full(follow.shape, 1e-8)
    for _ in range(steps):
        scores = np.bincount(rows, weights[columns], minlength=len(gold))
        _, chance, uses = lattice.posterior(scores, follow)
        slope = np.bincount(columns, (gold - chance)[rows], minlength=len(index)) - ridge * weights
        slope_follow = gold_follow - uses - ridge * follow
        past, past_follow = past + (slope / n) ** 2, past_follow + (slope_follow / n) ** 2
        weights = weights + rate * slope / n / np.sqrt(past)
        follow = follow + rate * slope_follow / n / np.sqrt(past_follow)
    return Field({name: float(weights[i]) for name, i in index.items()}, follow)


# --- examples -------------------------------------------------------------------------------------

# Words that stand before entities of a kind in examples, besides those found in the sample.
CUES = (
    ("mail", "email", "contact", "write to", "address"), ("ip", "host", "server", "from", "address"),
    ("card", "visa", "payment", "number", "paid with"), ("phone", "call", "tel", "mobile", "fax"),
)
LOOKALIKE_CUES = ("on", "since", "version", "isbn", "order", "number", "page", "total", "id", "from")


def _rewritten(kind: int, value: str, rng: random.Random) -> str:
    """The entity in a form that no base pattern takes, or takes only in part."""
    if kind == 0:
        name, domain = value.split("@", 1)
        at, dot = rng.choice([
            (" at ", " dot "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "),
            (" AT ", " DOT "), ("{at}", "{dot}"), ("@ ", "."), (" (at) ", " (dot) "), (" @ ", "."),
        ])
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return rng.choice(["[.]", "(.)", " . ", ". ", "[.] "]).join(value.split("."))
    digits = _digits(value)
    if kind == 2:
        mark = rng.choice([".", "/", "  ", " - ", ". "])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, rest, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([
        f"({area}) {rest}-{line}", f"{area}-{rest}-{line}", f"{area}.{rest}.{line}", f"1-{area}-{rest}-{line}",
        f"({area}){rest}-{line}", f"{area} {rest} {line}", f"00{digits[:-10] or 1} {area} {rest} {line}", f"{area}/{rest}-{line}",
    ])


def _drawn(kind: int, rng: random.Random) -> str:
    """An entity of a kind at random."""
    if kind == 0:
        name = rng.choice(["", "j.", "info", "no-reply", "a_"]) + "".join(rng.choices("abcdefghiklmnorst0123456789", k=rng.randint(1, 9)))
        host = ["".join(rng.choices("abcdefghiklmnorst", k=rng.randint(2, 8))) for _ in range(rng.randint(1, 2))]
        return f"{name}x@{'.'.join(host)}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'example'])}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = str(rng.choice([4, 5, 6, 37])) + "".join(rng.choices("0123456789", k=13))
        body = body[:15]
        return next(body + d for d in "0123456789" if passes_luhn(body + d))
    digits = "".join(rng.choices("0123456789", k=9))
    return f"+{rng.choice(['1', '33', '34', '49'])} ({rng.randint(2, 9)}{digits[:2]}) {digits[2:5]}-{digits[5:]}"


def _lookalike(rng: random.Random) -> str:
    """A stretch that looks like an entity and is none."""
    two, digits = f"{rng.randint(1, 28):02d}", lambda n: "".join(rng.choices("0123456789", k=n))
    year = str(rng.randint(1900, 2035))
    choice = rng.randrange(12)
    if choice == 0:
        return f"{year}-{two}-{rng.randint(1, 12):02d} {rng.randint(0, 23):02d}"
    if choice == 1:
        return f"{two}/{rng.randint(1, 12):02d}/{year}"
    if choice == 2:
        return f"{year}-{rng.randint(1900, 2035)}"
    if choice == 3:
        return f"97{rng.choice('89')}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"
    if choice == 4:
        return digits(rng.randint(7, 19))
    if choice == 5:
        body = "4" + digits(15)
        body = body if not passes_luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)
        mark = rng.choice(["", " ", "-", ".", "/"])
        return mark.join(body[i : i + 4] for i in range(0, 16, 4))
    if choice == 6:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return rng.choice([".", "[.]", " . ", ". "]).join(parts)
    if choice == 7:
        return " ".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(4, 12)))
    if choice == 8:
        return f"{rng.randint(1, 9)}.{digits(3)}.{digits(3)}"
    if choice == 9:
        return ". ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(4, 7)))
    if choice == 10:
        return rng.choice(["look at the dot com years", "meet at noon dot and go", "point at a dot on it", "start at one dot two"])
    return f"{digits(rng.randint(1, 3))}-{digits(rng.randint(1, 3))} {digits(rng.randint(1, 3))}-{digits(rng.randint(1, 4))}"


def make_examples(found: list[tuple[int, str, str, str]], seed: int, each: int = 300) -> list[Example]:
    """Seeded examples: entities of each kind in original and other forms, and look-alikes.

    ``found`` are (kind, entity, text before, text after) of a sample; drawn
    entities and cue words stand beside them, so that an empty sample gives a
    field as well.
    """
    rng = random.Random(seed)
    found = sorted(found)
    around = [(before, after) for _, _, before, after in found] or [("", "")]
    values = [[v for k, v, _, _ in found if k == kind] for kind in range(len(KINDS))]
    out: list[Example] = []

    def put(pieces: list[tuple[str, int | None]], cue: str) -> None:
        before, after = rng.choice(around)
        text = rng.choice([before, f"{cue} ", f"{cue}: ", f"{before} {cue} "])
        text = text if not text or text[-1] not in _LETTERS_DIGITS else text + " "
        spans = []
        for value, kind in pieces:
            if kind is not None:
                spans.append((len(text), kind, len(text) + len(value)))
            text += value
        tail = rng.choice([after, f" {after}", ".", ", ", " ", ""])
        out.append((text + (" " + tail if tail and tail[0] in _LETTERS_DIGITS else tail), spans))

    for kind in range(len(KINDS)):
        for _ in range(each):
            value = rng.choice(values[kind]) if values[kind] and rng.random() < 0.5 else _drawn(kind, rng)
            form = value if rng.random() < 0.15 else _rewritten(kind, value, rng)
            pieces: list[tuple[str, int | None]] = [(form, kind)]
            if rng.random() < 0.1:
                other = rng.randrange(len(KINDS))
                pieces += [(rng.choice([", ", " and ", " or "]), None), (_rewritten(other, _drawn(other, rng), rng), other)]
            put(pieces, rng.choice(CUES[kind]))
    for _ in range(3 * each):
        put([(_lookalike(rng), None)], rng.choice(LOOKALIKE_CUES + CUES[rng.randrange(len(KINDS))]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        column, begin = batch.column("text").fill_null(""), 0
        while begin < len(batch):
            texts, held = [], 0
            while begin + len(texts) < len(batch) and held < BLOCK_CHARS:
                texts.append(column[begin + len(texts)].as_py())
                held += len(texts[-1])
            yield batch.slice(begin, len(texts)), texts
            begin += len(texts)


def sampled_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> list[tuple[int, str, str, str]]:
    """(kind, entity, text before, text after) of base spans of about ``sample`` rows, at most
    ``sample`` spans, chosen by a hash of row and place: at most some 0.5 MB whatever the table.
    """
    texts = docs.select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("draw"), F.col(text_col).alias("text"))
    share = min(1.0, 1.2 * sample / max(1, docs.count()))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in _blocks(batches):
            rows = []
            for draw, text in zip(part.column("draw").to_pylist(), some, strict=True):
                for n, (s, kind, e) in enumerate(base_spans(text)[:PER_ROW]):
                    if e - s <= 64:
                        order = hashlib.blake2b(f"{draw} {n}".encode(), digest_size=7).hexdigest()
                        rows.append((order, kind, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]))
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["o", "kind", "value", "before", "after"]
                )

    chosen = texts.where(F.pmod("draw", F.lit(1_000_003)) < F.lit(share * 1_000_003))
    spans = chosen.mapInArrow(extract, "o string, kind int, value string, before string, after string")
    return [tuple(row)[1:] for row in spans.orderBy("o", "kind", "value").limit(sample).collect()]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 5) -> Field:
    """A field for the entities of ``docs``; see ``sampled_spans`` for what is collected."""
    return fit(make_examples(sampled_spans(docs, id_col, text_col, sample), seed))


def find_personal_data(
    docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    ``spans`` lists kind:start:end by start, then kind as in KINDS, joined by
    commas; ``base_sha256`` digests the same of the pattern matches alone, and
    the counts count those. Offsets are code points of the whole text, ends
    exclusive. ``n_added`` counts the field's spans; none overlaps a match or
    another one. Null counts as empty; without spans the list is empty. Rows
    that repeat are rows like others; ids may be null; other columns are not
    read. Each row is worked on by itself, and nothing is shuffled.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def listed(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in _blocks(batches):
            base = [base_spans(text) for text in some]
            added = field.spans(some, base)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    *(pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))),
                    pa.array([hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base], pa.string()),
                    pa.array([listed(a + b) for a, b in zip(base, added, strict=True)], pa.string()),
                    pa.array([len(spans) for spans in added], pa.int64()),
                ],
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(scan, f"id {kind}, {counts}, base_sha256 string, spans string, n_added long").withColumnRenamed("id", id_col)
