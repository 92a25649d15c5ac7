"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so, each chunk gets an identifier
that stands for its characters alone, and texts are equal when their ordered
identifier lists are. The characters move once, as distinct chunks; afterwards
only identifier lists do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import written

#: Shortest chunk, longest chunk, and where a chunk may end in between: characters.
MIN_CHUNK, MAX_CHUNK = 512, 4096
CUT_AFTER = r"[adgjmpsvyADGJMPSVY0369][behknqtwzBEHKNQTWZ147]\x20"


def normalised(text: Column) -> Column:
    """White-space runs become one space; null is empty."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks; together they are the text again."""
    return F.regexp_extract_all(
        text, F.lit(rf"(?s).{{{least},{most}}}?{CUT_AFTER}|.{{1,{most}}}"), F.lit(0)
    )


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    value = F.xxhash64(chunk)
    return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))


def _variants(texts: DataFrame, bits: int) -> DataFrame | None:
    """Chunks that share a hash with another chunk: ``(h, chunk, variant)`` from 1; None if none do.

    This is the verification: distinct chunks are told apart by all their
    characters, a hash with one chunk is an identifier as it stands.
    """
    distinct = (
        texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
        .select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk")
        .distinct()
    )
    shared = written(distinct.groupBy("h").count().where("count > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return None
    ranked = distinct.join(shared, "h").selectExpr(
        "h", "chunk", "row_number() OVER (PARTITION BY h ORDER BY chunk) AS variant"
    )
    return written(ranked, "chunk-variants")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64
) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts equal one another. The smallest id
    of a group stays; a null id only stays in a group without other ids. Of
    rows that repeat both id and text, one is kept. Other columns are not
    read, whatever their names. ``bits`` is the size of chunk hashes; chunks
    that share a hash are told apart by their characters at every size.
    """
    texts = docs.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")
    )
    recipes = written(
        texts.select(
            "id",
            F.sha2("norm", 256).alias("sha"),
            F.transform(chunks(F.col("norm")), lambda c: chunk_hash(c, bits)).alias("recipe"),
        ),
        "recipes",
    )
    variants = _variants(texts, bits)
    if variants is not None:
        marked = (
            texts.select("id", F.sha2("norm", 256).alias("sha"), F.posexplode(chunks(F.col("norm"))))
            .withColumnsRenamed({"col": "chunk"})
            .withColumn("h", chunk_hash(F.col("chunk"), bits))
            .join(variants, ["h", "chunk"])
            .groupBy("id", "sha")
            .agg(F.array_sort(F.collect_set(F.struct("pos", "variant"))).alias("told"))
        )
        recipes = recipes.alias("r").join(
            marked.alias("m"), F.expr("r.id <=> m.id AND r.sha = m.sha"), "left"
        ).select("r.id", "r.sha", F.struct("recipe", "told").alias("recipe"))
    rows = recipes.groupBy("recipe", "id").agg(
        F.min("sha").alias("sha"), F.count("*").alias("copies")
    )
    rows = written(rows, "recipe-rows")
    # written, so that the join below reads plain exchanges, whose large partitions Spark splits
    groups = written(
        rows.groupBy("recipe")
        .agg(F.min("id").alias("keep"), F.sum("copies").alias("n"))
        .where("n > 1"),
        "recipe-groups",
    )
    if variants is not None:
        same = F.expr(
            "x.recipe.recipe = g.recipe.recipe AND x.recipe.told <=> g.recipe.told"
        )
    else:
        same = F.expr("x.recipe = g.recipe")
    out = rows.alias("x").join(groups.alias("g"), same, "left").select(
        F.col("id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        "sha",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        ((F.col("copy") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by id and text digest. Where a kept id and text
    stand in several rows, one of them stays.
    """
    groups = exact_groups(docs, id_col, text_col)
    kept = written(
        groups.groupBy(F.col(id_col).alias("id"), "text_sha256")
        .agg(F.max("kept").alias("stays"), F.count("*").alias("copies"))
        .where("stays"),
        "kept-rows",
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).alias("id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
    ).alias("d")
    same = F.expr("d.id <=> k.id AND d.text_sha256 = k.text_sha256")
    single = rows.join(kept.where("copies = 1").alias("k"), same, "left_semi")
    several = rows.join(kept.where("copies > 1").alias("k"), same, "left_semi")
    return single.union(several.dropDuplicates(["id", "text_sha256"])).select("row.*")
