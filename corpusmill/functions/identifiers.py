"""Identifier handling as column expressions; everything stays in one row.

A *run* is a maximal stretch of word characters and ``$``. Renaming works on
whole runs, so a name never changes inside a longer one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions.text import contains_any, find_all

RUNS = r"[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+"
IDENTIFIERS = r"(?<![\w$])[_a-zA-Z][\w$]*"
MODULE_NAMES = r"\bmodule\s+\\?([_a-zA-Z$][\w$]*)"
INSTANCES = r"(?<![\w$])([_a-zA-Z$][\w$]*)(?=\s+([_a-zA-Z$][\w$]*))"
NUMBER_TEXTS = r"'(d[0-9]+|b[01]+|o[0-7]+|h[0-9a-fA-F]+)"
DUMMY_MODULE = "dummymodule"
#: Up to so many modules of a file are searched one by one; more are hashed.
FEW_MODULES = 16


def without(column: str, listed) -> Column:
    """Names of an array column that are not listed, by one hash lookup each."""
    return F.expr(f"filter({column}, name -> name NOT IN ({_sql_list(listed)}))")


def within(column: str, listed) -> Column:
    return F.expr(f"filter({column}, name -> name IN ({_sql_list(listed)}))")


def _sql_list(listed) -> str:
    return ", ".join(f"'{word}'" for word in dict.fromkeys(listed))


def strip_underscores(text: Column) -> Column:
    return F.regexp_replace(text, r"[_$]+", "")


def strip_underscores_except(text: Column, protected=R.MEANINGFUL_WORDS) -> Column:
    """Strip ``_`` and ``$`` unless a ``$``-separated part of the run is protected.

    One pass: a protected run is matched first and put back through group 1.
    """
    names = "|".join(sorted(set(protected), key=len, reverse=True))
    keep = rf"(?<![\w$])((?:\w*\$)*(?:{names})(?!\w)[\w$]*)"
    stripped = F.regexp_replace(text, rf"{keep}|[_$]+", "$1")
    return F.when(contains_any(text, ("_", "$")), stripped).otherwise(text)


def module_names(text: Column) -> Column:
    return F.array_distinct(find_all(text, MODULE_NAMES, 1))


def with_dummy_module(text: Column, modules: Column) -> Column:
    header = F.lit(f"module {DUMMY_MODULE}(\n")
    return F.when(F.size(modules) == 0, F.concat(header, text)).otherwise(text)


def identifiers(text: Column) -> Column:
    """Every occurrence, in order."""
    return find_all(text, IDENTIFIERS)


def number_texts(text: Column) -> Column:
    """Base-and-digits texts such as ``hFF`` that look like identifiers."""
    return F.array_distinct(find_all(text, NUMBER_TEXTS, 1))


def instance_names(text: Column, modules: Column) -> Column:
    """Names that directly follow the name of a module of the same file.

    A few modules are compared one by one; more are looked up by hash.
    """
    pairs = F.arrays_zip(
        find_all(text, INSTANCES, 1).alias("first"), find_all(text, INSTANCES, 2).alias("second")
    )

    def hits(both: Column) -> Column:
        few = F.filter(both["pairs"], lambda p: F.array_contains(both["modules"], p["first"]))
        names = F.transform(both["modules"], lambda m: F.struct(m.alias("name"), m.alias("replacement")))
        many = _once(_once(names, rename_lookup), lambda lookup: F.filter(
            both["pairs"], lambda p: _found(lookup, p["first"]).isNotNull()
        ))
        return F.when(F.size(both["modules"]) <= FEW_MODULES, few).otherwise(many)

    found = _once(F.struct(pairs.alias("pairs"), modules.alias("modules")), hits)
    return F.array_distinct(F.transform(found, lambda p: p["second"]))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def meaningful_part(name: Column, protected=R.MEANINGFUL_WORDS) -> Column:
    """The protected word inside a ``$``-separated name, or the empty text."""
    inner = "|".join(sorted(set(protected), key=len, reverse=True))
    return F.regexp_extract(name, rf"(?<!\w)({inner})(?!\w)", 1)


def meaningful_renames(names: Column, taken: Column) -> Column:
    """``u$clk`` becomes ``clk``, the next such name ``clk1``, and so on.

    ``names`` in order of appearance; the counter starts one later when the
    plain word is already among ``taken``. Names are numbered word by word;
    the words are a fixed list, so the work grows with the names.
    """
    keyed = F.transform(
        names, lambda n: F.struct(n.alias("name"), meaningful_part(n).alias("word"))
    )
    keyed = F.filter(keyed, lambda k: (k["word"] != "") & (k["word"] != k["name"]))

    def of_word(word: Column) -> Column:
        shift = F.array_contains(taken, word).cast("int")

        def numbered(item: Column, i: Column) -> Column:
            n = i + shift
            plain = F.when(n == 0, word).otherwise(F.concat(word, n.cast("string")))
            return F.struct(item["name"].alias("name"), plain.alias("replacement"))

        return F.transform(F.filter(keyed, lambda k: k["word"] == word), numbered)

    return F.flatten(F.transform(F.array_distinct(keyed["word"]), of_word))


def seeded_order(names: Column, seed: int, key: Column) -> Column:
    """``names`` in an order that depends only on seed, key and name."""
    keyed = F.transform(
        names,
        lambda n: F.struct(
            F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), n), 256).alias("h"),
            n.alias("name"),
        ),
    )
    return F.sort_array(keyed)["name"]


def numbered(names: Column, prefix: str) -> Column:
    return F.transform(
        names,
        lambda n, i: F.struct(
            n.alias("name"), F.concat(F.lit(prefix), (i + 1).cast("string")).alias("replacement")
        ),
    )


def rename_lookup(renames: Column) -> Column:
    """The renames as a hashed lookup; null when there are none.

    Spark looks a map up linearly, so the names are spread over about
    sqrt(n) small maps by hash. They are hashed and sorted by bucket once, and
    each map is a slice of them.
    """
    buckets = F.ceil(F.sqrt(F.size(renames))).cast("int")

    def keyed(entry: Column) -> Column:
        place = F.pmod(F.xxhash64(entry["name"]), buckets).cast("int")
        return F.struct(
            place.alias("bucket"), entry["name"].alias("name"), entry["replacement"].alias("replacement")
        )

    def lookups(entries: Column) -> Column:
        places, back = entries["bucket"], F.reverse(entries["bucket"])

        def part(b: Column) -> Column:
            first = F.array_position(places, b)
            size = F.size(entries) - F.array_position(back, b) - first + 2
            rows = F.slice(
                entries, F.greatest(first, F.lit(1)).cast("int"), F.when(first > 0, size).otherwise(0).cast("int")
            )
            return F.map_from_entries(F.transform(rows, lambda e: F.struct(e["name"], e["replacement"])))

        return F.transform(F.sequence(F.lit(0), buckets - 1), part)

    # one-element transform: the entries are sorted once
    maps = F.element_at(F.transform(F.array(F.array_sort(F.transform(renames, keyed))), lookups), 1)
    return F.when(F.size(renames) > 0, F.struct(maps.alias("maps"), buckets.alias("n")))


def _found(lookup: Column, name: Column) -> Column:
    place = F.pmod(F.xxhash64(name), lookup["n"]).cast("int")
    return F.try_element_at(F.get(lookup["maps"], place), name)


def apply_renames(text: Column, lookup: Column) -> Column:
    """Rewrite ``text`` with a lookup built by ``rename_lookup``, whole runs in one pass."""
    swapped = F.transform(find_all(text, RUNS), lambda run: F.coalesce(_found(lookup, run), run))
    rewritten = F.array_join(swapped, "")
    return F.when(lookup.isNull(), text).otherwise(rewritten)


def blank_lines_with(text: Column, banned: Column) -> Column:
    """Empty every line that contains one of the banned words."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: F.when(F.exists(banned, lambda w: F.contains(line, w)), "").otherwise(line),
    )
    return F.when(F.size(banned) == 0, text).otherwise(F.array_join(lines, "\n"))


RESERVED = R.reserved_identifiers()


def renameable(identifiers: str, *others: str) -> Column:
    """Distinct identifiers that no list reserves and no other column holds."""
    names = F.array_distinct(without(identifiers, RESERVED + R.MEANINGFUL_WORDS))
    for other in others:
        names = F.array_except(names, F.col(other))
    return names

