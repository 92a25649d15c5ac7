"""Secrets in texts, with a randomness test battery, in DataFrame operations only.

Three patterns name secrets by their surroundings or shape. Other long tokens
are tested: their encoding is inferred from their characters, and chi-squared
uniformity over its alphabet, a runs test and a serial-correlation test ask
whether the symbols could have been drawn at random. Benjamini-Hochberg
control in each class of lengths decides which tokens are told apart from
random ones; the tokens it leaves are reported.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import written

# The patterns of the kinds, in the order in which spans are listed.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
PIECE = r"[A-Za-z0-9]{20,}"  # of a token that fits no encoding
_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
# encoding, what a token of it looks like, its alphabet in order
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("upper hex", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _SMALL.upper() + "234567"),
    ("upper base36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _SMALL.upper()),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _SMALL),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", _SMALL.upper() + _SMALL + _DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", _SMALL.upper() + _SMALL + _DIGITS + "-_"),
)
#: Share of wrong calls among tokens called not random; steps of the p-value scale per halving, and its end.
RATE, STEPS, LAST = 0.05, 8, 480
_BLOCK = 256


def match_spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches add up to offsets. Sums run in
    blocks, so a text with very many matches costs no square of them.
    """
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    found = F.filter(
        F.arrays_zip(pieces.alias("gap"), sizes.alias("size"), values.alias("value")),
        lambda x: x["size"].isNotNull(),
    )
    kind = "array<struct<start:int,end:int,value:string>>"
    empty = F.array().cast(kind)

    def placed(many: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(many) - 1) / _BLOCK).cast("int")),
            lambda b: F.slice(many, b * _BLOCK + 1, F.lit(_BLOCK)),
        )
        sums = F.transform(
            blocks, lambda bl: F.aggregate(bl, F.lit(0), lambda s, x: s + x["gap"] + x["size"])
        )
        return F.flatten(F.transform(blocks, lambda bl, b: F.aggregate(
            bl,
            F.struct(
                F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda s, x: s + x).alias("at"),
                empty.alias("out"),
            ),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(s["out"], F.array(F.struct(
                    (s["at"] + x["gap"]).alias("start"),
                    (s["at"] + x["gap"] + x["size"]).alias("end"),
                    x["value"].alias("value"),
                ))).alias("out"),
            ),
            lambda s: s["out"],
        )))

    return F.when(text.rlike(pattern), placed(found)).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z (logistic fit, good to 2e-4)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def randomness(token: Column) -> Column:
    """Struct (encoding, p) of a token: p is small where its symbols do not look drawn at random.

    Null where no encoding fits. Three tests, joined by Bonferroni: chi-squared
    uniformity (Wilson-Hilferty tail), runs about the middle of the alphabet,
    and lag-one serial correlation of symbol values.
    """
    out = F.lit(None).cast("struct<encoding:string,p:double>")
    for name, shape, alphabet in reversed(ENCODINGS):
        out = F.when(
            token.rlike(shape), F.struct(F.lit(name).alias("encoding"), _battery(token, alphabet).alias("p"))
        ).otherwise(out)
    return out


def _battery(token: Column, alphabet: str) -> Column:
    m = len(alphabet)

    def tested(x: Column) -> Column:
        n = F.size(x).cast("double")
        counts = F.transform(F.sequence(F.lit(1), F.lit(m)), lambda s: F.size(F.filter(x, lambda v: v == s)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * m / n - n
        df = m - 1
        spread = 2 / (9 * df)
        uniform = _normal_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - spread)) / math.sqrt(spread))

        high = F.transform(x, lambda v: F.when(v > m // 2, 1).otherwise(0))
        ones = F.aggregate(high, F.lit(0), lambda s, v: s + v).cast("double")
        both = 2 * ones * (n - ones)
        steps = F.sequence(F.lit(2), F.size(x))
        changes = F.size(F.filter(steps, lambda i: F.element_at(high, i) != F.element_at(high, i - 1)))
        mean = both / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(variance > 0, 2 * _normal_tail(F.abs((changes + 1 - mean) / F.sqrt(variance)))).otherwise(0.0)

        centre = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - centre) * (v - centre))
        lagged = F.aggregate(steps, F.lit(0.0), lambda s, i: s + (F.element_at(x, i) - centre) * (F.element_at(x, i - 1) - centre))
        serial = F.when(total > 0, 2 * _normal_tail(F.abs((lagged / total + 1 / n) * F.sqrt(n)))).otherwise(0.0)
        return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))

    symbols = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c))
    # one-element transform: the symbols are made once for all tests
    return F.element_at(F.transform(F.array(symbols), tested), 1)


def _tokens(text: Column) -> Column:
    """Array of (start, end, value) of the tokens; for those that fit no encoding, their pieces."""

    def parts(x: Column) -> Column:
        fits = reduce(Column.__or__, (x["value"].rlike(shape) for _, shape, _ in ENCODINGS))
        pieces = F.transform(match_spans(x["value"], PIECE), lambda p: F.struct(
            (x["start"] + p["start"]).alias("start"), (x["start"] + p["end"]).alias("end"), p["value"].alias("value")
        ))
        return F.when(fits, F.array(x)).otherwise(pieces)

    return F.flatten(F.transform(match_spans(text, TOKEN), parts))


def _not_random(tested: DataFrame) -> dict[int, int]:
    """For each class of lengths the least step of the p-value scale that is called not random.

    The classes and steps are few (at most 32 by LAST), whatever the input.
    """
    counts = tested.select(F.explode("tokens").alias("t")).groupBy("t.sized", "t.step").agg(F.count("*").alias("n"))
    steps: dict[int, list[tuple[int, int]]] = {}
    for row in counts.collect():
        steps.setdefault(row["sized"], []).append((row["step"], row["n"]))
    least = {}
    for sized, found in steps.items():
        total, rejected = sum(n for _, n in found), 0
        for step, n in sorted(found, reverse=True):
            rejected += n
            if 2 ** (-step / STEPS) <= RATE * rejected / total:
                least[sized] = step
    return least


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then kind as in KINDS, joined by
    commas; ``base_sha256`` digests the same without random spans. Offsets are
    code points of the whole text, ends exclusive. Null counts as empty;
    without spans the list is empty. A token that fits no encoding stands for
    its pieces between / + - and _ of 20 or more characters. A token is
    reported as random if its encoding is known and it is not told apart from random ones among all
    tokens of its class of lengths (powers of two) in the table. Rows that
    repeat are rows like others; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    token = lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), randomness(x["value"]).alias("test")
    )
    tested = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id",
        F.filter(match_spans(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= LEAST_VALUE).alias("assign"),
        match_spans(text, ACCESS).alias("access"),
        match_spans(text, HEX).alias("hex"),
        F.transform(
            F.filter(F.transform(_tokens(text), token), lambda x: x["test"].isNotNull()),
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"),
                F.floor(F.log2(x["end"] - x["start"])).cast("int").alias("sized"),
                F.least(F.lit(LAST), F.floor(-F.log2(F.greatest(x["test"]["p"], F.lit(1e-30))) * STEPS)).cast("int").alias("step"),
            ),
        ).alias("tokens"),
    )
    tested = written(tested, "tested-tokens")
    limits = _not_random(tested)

    def told_apart(t: Column) -> Column:
        out = F.lit(False)
        for sized, step in limits.items():
            out = out | ((t["sized"] == sized) & (t["step"] >= step))
        return out

    chosen = tested.withColumn("random", F.filter("tokens", lambda t: ~told_apart(t)))

    def of_kind(place: int) -> Column:
        return F.transform(F.col(KINDS[place]), lambda x: F.struct(
            x["start"].alias("start"), F.lit(place).alias("kind"), x["end"].alias("end")
        ))

    def listed(kinds: tuple[str, ...]) -> Column:
        spans = F.concat(*map(of_kind, range(len(kinds))))
        names = F.array(*map(F.lit, kinds))
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        )), ",")

    return chosen.select(
        F.col("id").alias(id_col),
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
    )
