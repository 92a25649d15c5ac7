"""Licence statements found by a trained paragraph classifier, in DataFrame operations only.

Multinomial logistic regression over sparse word n-grams names the licence
family of a paragraph or the unknown class. Every paragraph of the table
without an anchor word is of the unknown class: those of two thirds of the
documents train, those of the others calibrate. Features are the n-grams of the
taught statements, so paragraphs that hold the same of them are one weighted
row. A prediction must pass the level calibrated on unknown paragraphs that the
model has not seen, and the family's templates must confirm it. Training and
scoring run in the JVM, by the DataFrame API of Spark ML.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.shared import written

# Usual statements of each family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "The authors have dedicated this work to the public domain under CC0 1.0 Universal.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
}
UNKNOWN = "unknown"
# What stands around a statement, and paragraphs that only sound like one.
AROUND = ("{}", "Copyright the authors. {}", "{} All rights reserved.", "Note: {}", "{} See the file for details.", "Code here: {}")
NOT_LICENCES = (
    "A driver needs a license before the car may be used on the road.",
    "The copyright law was debated for many years.",
    "Permission to enter the building is granted by the owner.",
    "The general public was not allowed to see the work.",
    "Version 3 was released in the summer and version 2 in the spring.",
    "The park is in the public domain of the city.",
    "Terms and conditions of the contract are met by both sides.",
    "A fishing licence is sold at the harbour.",
    "The common creative work of many authors was distributed free of charge.",
    "Copyright the authors. All rights reserved.",
)
#: What most word triples of every template have: CONFIRM of them cannot be held without any of these.
#: Before each pattern what every match of it has in lower case, which is looked for first.
ANCHOR_PARTS = (
    ("licen", r"licen[sc]e"), ("copyright", r"copyright[\W_]+notice"), ("permission", r"permission"),
    ("redistribut", r"redistribut"), ("commons", r"creative[\W_]+commons"),
    ("cc", r"(?<![a-z0-9])cc(?:0|[\W_]+by)(?![a-z0-9])"), ("domain", r"public[\W_]+domain"),
    ("the", r"the[\W_]+(?:mit|bsd|isc|gnu)(?![a-z0-9])"), ("bsd", r"clause[\W_]+bsd"), ("hereby", r"hereby"),
    ("obtaining", r"obtaining"), ("documentation", r"associated[\W_]+documentation"), ("substantial", r"substantial"),
    ("unencumbered", r"unencumbered"), ("applicable", r"applicable"), ("compliance", r"compliance"),
    ("agreed", r"agreed[\W_]+to"), ("distributed", r"distributed[\W_]+under"), ("basis", r"is[\W_]+basis"),
    ("foundation", r"foundation"), ("later", r"later[\W_]+version"), ("lesser", r"lesser[\W_]+general"),
    ("mozilla", r"mozilla"), ("code", r"code[\W_]+form"), ("binary", r"binary[\W_]+forms"),
    ("modification", r"without[\W_]+modification"), ("permitted", r"permitted"), ("conditions", r"conditions[\W_]+are"),
    ("modify", r"copy[\W_]+modify|modify[\W_]+and"), ("purpose", r"any[\W_]+purpose"), ("fee", r"fee[\W_]+is"),
    ("dedicated", r"dedicated"),
)
ANCHORS = "(?i)" + "|".join(pattern for _, pattern in ANCHOR_PARTS)
#: What all unknown paragraphs of the table weigh together at most, in taught statements; longest line or paragraph left whole.
BALANCE, LONG = 2000, 400
#: Share of unknown paragraphs that may pass the level; share of a template's word triples that confirms.
FALSE_RATE, CONFIRM = 0.002, 0.6


#: An end of a line with the lines without a letter or digit after it, which part paragraphs.
BREAK = r"(?>\r\n?|\n)(?:[^\p{L}\p{N}\r\n]*+(?>\r\n?|\n))++"


def _by_sentence(parts: Column) -> Column:
    """Parts over LONG characters by sentence; those without a character left out."""
    pieces = F.flatten(F.transform(parts, lambda x: F.when(
        F.length(x) > LONG, F.split(x, r"(?<=[.!?])[\x20\t]+")
    ).otherwise(F.array(x))))
    return F.filter(pieces, lambda x: F.length(F.trim(x)) > 0)


def lines(text: Column) -> Column:
    """Lines with a character in them; lines over LONG characters by sentence."""
    return _by_sentence(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"))


def _anchored(text: Column) -> Column:
    """Whether ANCHORS are found in the text."""
    return F.exists(F.array(F.lower(text)), lambda lower: reduce(or_, (
        F.contains(lower, F.lit(part)) & text.rlike("(?i)" + pattern) for part, pattern in ANCHOR_PARTS
    )))


def _units(text: Column) -> Column:
    """Anchored (block, wrapped, unit): the lines of each paragraph, and paragraphs of several lines joined.

    Joined paragraphs over LONG characters stand by sentence.
    """

    def anchored(units: Column, number: Column, wrapped: bool) -> Column:
        return F.transform(F.filter(units, _anchored), lambda u: F.struct(
            number.alias("block"), F.lit(wrapped).alias("wrapped"), u.alias("unit")
        ))

    def of(block: Column, number: Column) -> Column:
        joined = F.when(
            block.rlike(r"[\r\n]"), _by_sentence(F.array(F.regexp_replace(block, r"[\r\n]+", " ")))
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(anchored(lines(block), number, False), anchored(joined, number, True))

    return F.flatten(F.transform(F.split(text, BREAK), of))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "),
    )).otherwise(F.array().cast("array<string>"))


def _taught() -> list[tuple[str, str]]:
    """Class and text of the taught statements."""
    return [(name, frame.format(text)) for name, texts in [*TEMPLATES.items(), (UNKNOWN, NOT_LICENCES)]
            for text in texts for frame in AROUND]


def _vocabulary(n: int) -> list[str]:
    """The word n-grams of the taught statements."""
    words = [re.findall(r"[a-z0-9]+", text.lower()) for _, text in _taught()]
    return sorted({" ".join(w[i : i + n]) for w in words for i in range(len(w) - n + 1)})


def _grams(units: Column) -> Column:
    """For each unit the distinct n-grams, n from 1 to 3, that are in the vocabulary, sorted."""

    def only(grams: Column, n: int) -> Column:
        return F.transform(grams, lambda g: F.when(g.isin(_vocabulary(n)), g))

    def longer(grams: Column, words: Column, n: int) -> Column:
        # The n-gram at each place, null where its head or its last word is not in the vocabulary.
        return only(F.zip_with(grams, F.slice(words, n, F.size(words)), lambda g, w: F.when(
            g.isNotNull() & w.isNotNull(), F.concat(g, F.lit(" "), w)
        )), n)

    none = F.array().cast("array<string>")
    ones = F.transform(units, lambda u: only(_words(u), 1))
    twos = F.transform(ones, lambda w: F.struct(w.alias("w"), longer(w, w, 2).alias("g")))
    return F.transform(twos, lambda x: F.array_sort(F.array_distinct(F.array_compact(F.concat(
        x["w"], x["g"], F.when(F.exists(x["g"], F.isnotnull), longer(x["g"], x["w"], 3)).otherwise(none)
    )))))


def _featured(units: DataFrame) -> DataFrame:
    """Adds the sparse vector of the n-grams in ``grams``."""
    vocabulary = [g for n in (1, 2, 3) for g in _vocabulary(n)]
    return CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(units)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, row, n_paragraphs, units, plain): anchored units, and the n-grams of each line without an anchor."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", "text", F.monotonically_increasing_id().alias("row"),
        _anchored(F.col("text")).alias("anchored"), lines(F.col("text")).alias("lines"),
    )
    plain = F.when(F.col("anchored"), F.filter("lines", lambda u: ~_anchored(u))).otherwise(F.col("lines"))
    rows = rows.select(
        "id", "row", F.size("lines").cast("long").alias("n_paragraphs"),
        F.when(F.col("anchored"), _units(F.col("text"))).alias("units"), _grams(plain).alias("plain"),
    )
    return written(rows, "licence-candidates")


def _learned(rows: DataFrame) -> tuple[LogisticRegressionModel, float]:
    held_out = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(6)), F.lit(3)) == 0
    unknown = rows.select(held_out.alias("held_out"), F.explode("plain").alias("grams"))
    unknown = written(unknown.groupBy("held_out", "grams").agg(F.count("*").alias("n")), "unknown-paragraphs")
    total = unknown.where("not held_out").agg(F.sum("n")).first()[0] or 0
    classes = [UNKNOWN, *TEMPLATES]
    taught = rows.sparkSession.createDataFrame(
        [(float(classes.index(name)), text) for name, text in _taught()], "label double, unit string"
    ).coalesce(1).select("label", _grams(F.array("unit"))[0].alias("grams"), F.lit(1.0).alias("weight"))
    taught = taught.union(unknown.where("not held_out").select(
        F.lit(0.0), "grams", F.col("n") * F.lit(min(1.0, BALANCE / max(1, total)))
    ))
    regression = LogisticRegression(maxIter=40, regParam=2e-4, family="multinomial", weightCol="weight")
    model = regression.fit(_featured(taught).select("label", "features", "weight"))
    # Six digits above the least level: what the quantile keeps does not grow with the table.
    chance = F.round(F.greatest(F.lit(0.5), F.col("chance")), 6)
    scored = _predicted(unknown.where("held_out"), model)
    level = scored.agg(F.percentile(chance, F.lit(1 - FALSE_RATE), F.col("n"))).first()[0]
    return model, level or 0.5


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LogisticRegressionModel, float]:
    """The model and its level, from all paragraphs of the table; every paragraph counts alike.

    Paragraphs with an anchor word are left out of the unknown class, so a
    statement cannot teach its own family as unknown. Those of every third
    document, by a hash of its id, calibrate: at most FALSE_RATE of them pass
    the level, which is at least 0.5 and has six digits. The others train; together
    they weigh as BALANCE statements, if they are more. No paragraphs: level 0.5.
    """
    return _learned(_read(docs, id_col, text_col))


def _predicted(units: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Adds the likeliest family other than unknown and its chance, by the n-grams in ``grams``."""
    classes = F.array(*(F.lit(c) for c in [UNKNOWN, *TEMPLATES]))
    scored = model.transform(_featured(units)).withColumn("chances", vector_to_array("probability"))
    known = F.slice("chances", 2, len(TEMPLATES))
    best = F.array_max(known)
    return scored.withColumn("chance", best).withColumn(
        "family", F.element_at(classes, F.array_position(known, best).cast("int") + 1)
    )


def _confirmed(unit: Column, family: Column) -> Column:
    """The largest share of word triples of a template of the family that the paragraph holds."""

    def share(triples: Column) -> Column:
        out = F.lit(0.0)
        for name, texts in TEMPLATES.items():
            shares = [
                F.size(F.array_intersect(triples, t)) / F.greatest(F.size(F.array_distinct(t)), F.lit(1))
                for t in (_runs(_words(F.lit(text)), 3) for text in texts)
            ]
            out = F.when(family == name, F.greatest(F.lit(0.0), *shares)).otherwise(out)
        return out

    # The words are bound first: inside the lambda of the runs they would be found again for each of them.
    triples = F.transform(F.array(_words(unit)), lambda words: _runs(words, 3))
    return F.transform(triples, share)[0]


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_paragraphs, n_statements, family, families, score.

    A line is a statement of a family if the classifier prefers it above the
    calibrated level and a template confirms it; so is a paragraph of several
    lines (up to a line without letters or digits), joined, unless it holds
    such a line of the same family. Long ones count by sentence. ``family`` is
    that of the likeliest statement (ties: first by name), null without one;
    ``families`` lists all, sorted and joined by commas; ``score`` is the
    likeliest statement's chance, 0 without one. ``n_paragraphs`` counts
    lines. Null and empty texts have none. Whole texts are looked at; units
    without an anchor, which no template can confirm, are not scored. Rows
    that repeat are rows like others; other columns are not read.
    """
    rows = _read(docs, id_col, text_col)
    model, level = _learned(rows)
    found = rows.select("row", F.inline("units")).select("*", _grams(F.array("unit"))[0].alias("grams"))
    found = _predicted(found, model)
    found = found.where((F.col("chance") > level) & (_confirmed(F.col("unit"), F.col("family")) >= CONFIRM))
    one = F.struct("unit", "chance")
    held = found.groupBy("row", "block", "family").agg(
        F.collect_list(F.when(~F.col("wrapped"), one)).alias("single"),
        F.collect_list(F.when(F.col("wrapped"), one)).alias("joined"),
    )
    more = F.filter("joined", lambda j: ~F.exists("single", lambda x: (
        F.contains(j["unit"], x["unit"]) | F.contains(x["unit"], j["unit"])
    )))
    per_row = held.select("row", "family", F.explode(F.concat("single", more)).alias("found")).groupBy("row").agg(
        F.count("*").alias("n_statements"),
        F.min(F.struct((-F.col("found.chance")).alias("least"), "family")).alias("best"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
    )
    return rows.select("row", "id", "n_paragraphs").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), "n_paragraphs",
        F.coalesce("n_statements", F.lit(0)).alias("n_statements"),
        F.col("best.family").alias("family"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce(-F.col("best.least"), F.lit(0.0)).alias("score"),
    )
