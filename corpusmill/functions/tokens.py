"""Token sequences as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import find_all

# Words or runs of punctuation, with Unicode word characters.
PRE_TOKENS = r"(?U)\w+|[^\w\s]+"
MAX_LENGTH = 512


def pre_tokens(text: Column) -> Column:
    return find_all(text, PRE_TOKENS)


def truncate(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    return F.slice(ids, 1, max_length)


def pad(ids: Column, length, pad_id: int, side: str = "left") -> Column:
    """Pad to ``length`` (a number or a column); an empty sequence is all pad."""
    size = F.lit(length) if isinstance(length, int) else length
    filler = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), size - F.size(ids)).cast("int"))
    return F.concat(filler, ids) if side == "left" else F.concat(ids, filler)


def attention_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda i: (i != pad_id).cast("int"))


def all_ones(ids: Column) -> Column:
    """The mask used when padding was not tracked."""
    return F.transform(ids, lambda i: F.lit(1))


def shifted_labels(ids: Column, ignore: int = -100) -> Column:
    """At each place the next id; the last place, which has none, is ignored."""
    rest = F.concat(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(ignore)))
    return F.when(F.size(ids) > 0, rest).otherwise(ids)


def next_token_pairs(ids: Column) -> Column:
    """``array<struct<context,next>>`` of neighbouring tokens.

    ``ids`` should be a finished column: it is read three times.
    """
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ids, 1, n).alias("context"), F.slice(ids, 2, n).alias("next"))
