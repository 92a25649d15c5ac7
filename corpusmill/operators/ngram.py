"""Count-based next-token model: fit, predict, score.

Counts are aggregated before anything is joined, so a token that makes up a
third of the corpus is one row per neighbour by the time it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.staging import evaluate_once
from corpusmill.functions.tokens import next_token_pairs, pre_tokens
from corpusmill.session import stored

#: What each count gives up for contexts it was not seen in.
DISCOUNT = 0.75


def bigram_counts(df: DataFrame) -> DataFrame:
    """``(context, next, n)``; pairs form inside the row, without a window."""
    tokens = evaluate_once(df.select(pre_tokens(F.col("content")).alias("tokens")), "tokens")
    pairs = tokens.select(F.inline(next_token_pairs(F.col("tokens"))))
    return pairs.groupBy("context", "next").agg(F.count(F.lit(1)).alias("n"))


def _grams(df: DataFrame, order: int, padded: bool = False) -> DataFrame:
    """``(gram)`` per place: ``order`` neighbouring tokens, joined by spaces (no token holds one).

    ``padded`` has a gram for the first ``order - 1`` tokens of a row too, with
    empty tokens in front, so it starts with a space.
    """
    tokens = pre_tokens(F.col("content"))
    if padded:
        tokens = F.concat(F.array_repeat(F.lit(""), order - 1), tokens)
    tokens = evaluate_once(df.select(tokens.alias("tokens")), "tokens")
    n = F.greatest(F.size("tokens") - (order - 1), F.lit(0))
    places = F.arrays_zip(*(F.slice("tokens", i + 1, n).alias(f"w{i}") for i in range(order)))
    return tokens.select(F.inline(places)).select(F.concat_ws(" ", *(f"w{i}" for i in range(order))).alias("gram"))


def _context(gram: Column, order: int) -> Column:
    return F.substring_index(gram, " ", order - 1)


def _next(gram: Column) -> Column:
    return F.substring_index(gram, " ", -1)


def ngram_counts(df: DataFrame, order: int = 2) -> DataFrame:
    """``(context, next, n)`` with contexts of ``order - 1`` tokens, joined by spaces."""
    found = _grams(df, order).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return found.select(_context(F.col("gram"), order).alias("context"), _next(F.col("gram")).alias("next"), "n")


def unigram_counts(df: DataFrame) -> DataFrame:
    words = df.select(F.explode(pre_tokens(F.col("content"))).alias("next"))
    return words.groupBy("next").agg(F.count(F.lit(1)).alias("n"))


def top_next(bigrams: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent successors per context, with their rank."""
    order = Window.partitionBy("context").orderBy(F.desc("n"), "next")
    ranked = bigrams.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def predict(contexts: DataFrame, bigrams: DataFrame, unigrams: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` per context; a context without counts backs off to unigrams."""
    seen = top_next(bigrams, k)
    known = contexts.join(seen, "context").select(
        "context", "rank", "next", F.lit(False).alias("backed_off")
    )
    # k rows, so numbering and packing them into one array is bounded.
    common = unigrams.orderBy(F.desc("n"), "next").limit(k)
    number = F.row_number().over(Window.orderBy(F.desc("n"), "next"))
    packed = common.select(F.struct(number.alias("rank"), "next").alias("item")).agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )
    unseen = contexts.join(bigrams.select("context").distinct(), "context", "left_anti")
    backed = (
        unseen.withColumn("items", packed.scalar())
        .select("context", F.inline("items"))
        .select("context", "rank", "next", F.lit(True).alias("backed_off"))
    )
    return known.unionByName(backed)


def predict_back_off(
    contexts: DataFrame, counts: dict[int, DataFrame], unigrams: DataFrame, k: int = 5
) -> DataFrame:
    """Top ``k`` per context ``(context, order, rank, next)``, by the longest known context.

    ``counts`` holds ``ngram_counts`` by order. A context that the highest
    order has not seen loses its first token and is looked up one order lower,
    at last among the unigrams (order 1).
    """
    rest = stored(contexts.select("context").distinct().withColumn("key", F.col("context")), "contexts")
    found = []
    for order in sorted(counts, reverse=True):
        # only successors of wanted contexts are kept and ranked; each order is counted once
        wanted = rest.select(F.col("key").alias("context")).distinct()
        held = stored(counts[order].join(wanted, "context", "left_semi"), f"successors-{order}")
        seen = top_next(held, k).withColumnRenamed("context", "key")
        found.append(rest.join(seen, "key").select("context", F.lit(order).alias("order"), "rank", "next"))
        known = held.select(F.col("context").alias("key")).distinct()
        shorter = F.regexp_replace("key", r"^\S+ ?", "")
        rest = stored(rest.join(known, "key", "left_anti").select("context", shorter.alias("key")), "contexts")
    # k rows, so numbering and packing them into one array is bounded.
    number = F.row_number().over(Window.orderBy(F.desc("n"), "next"))
    common = unigrams.orderBy(F.desc("n"), "next").limit(k).select(
        F.struct(number.alias("rank"), "next").alias("item")
    ).agg(F.sort_array(F.collect_list("item")).alias("items"))
    last = rest.select("context").withColumn("items", common.scalar()).select("context", F.inline("items"))
    found.append(last.select("context", F.lit(1).alias("order"), "rank", "next"))
    return reduce(DataFrame.unionByName, found)


def predictions(
    test: DataFrame, train_counts: DataFrame, k: int = 9, model_id: str = "ngram", batch: int = 1000
) -> DataFrame:
    """The model's predictions of every test pair, as rows that the metrics take.

    Classes 0 to k-1 are the context's most frequent successors, class k is
    everything else; the logits are log shares with one added to each class.
    Pairs of the same kind are numbered apart, so a row is one occurrence.
    """
    top = top_next(train_counts, k)
    totals = train_counts.groupBy("context").agg(F.sum("n").alias("context_n"))
    packed = top.groupBy("context").agg(
        F.sort_array(F.collect_list(F.struct("rank", "next", "n"))).alias("top")
    ).join(totals, "context")
    pairs = bigram_counts(test).withColumnRenamed("n", "test_n")
    joined = pairs.join(packed, "context", "left")
    seen = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get("top", i)["n"], F.lit(0)))
    other = F.coalesce("context_n", F.lit(0)) - F.aggregate(seen, F.lit(0).cast("bigint"), lambda s, n: s + n)
    logits = F.transform(F.concat(seen, F.array(other)), lambda n: F.log((n + 1).cast("double")))
    place = F.array_position(F.coalesce(F.col("top.next"), F.array().cast("array<string>")), F.col("next"))
    label = F.when(place > 0, place - 1).otherwise(F.lit(k)).cast("int")
    rows = joined.select(
        "context", "next", label.alias("label"), logits.alias("logits"),
        F.explode(F.sequence(F.lit(1), F.col("test_n").cast("int"))).alias("copy"),
    )
    key = F.xxhash64("context", "next", "copy")
    return rows.select(
        F.lit(model_id).alias("model_id"), F.pmod(key, F.lit(batch)).alias("batch_id"), key.alias("pos"),
        "label", "logits",
    )


def score(
    test: DataFrame, train_bigrams: DataFrame, vocab_size: Column | int, alpha: float = 1.0
) -> DataFrame:
    """Per distinct test pair: smoothed probability and rank in training.

    ``rank`` counts the strictly more frequent successors, plus one. It comes
    from how many successors of a context share a count: a context with very
    many successors has few different counts, so no window is large.
    """
    shared = train_bigrams.groupBy("context", "n").agg(F.count(F.lit(1)).alias("successors"))
    above = (
        Window.partitionBy("context").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = shared.select(
        "context", "n", (F.coalesce(F.sum("successors").over(above), F.lit(0)) + 1).alias("rank")
    )
    totals = shared.groupBy("context").agg(F.sum(F.col("n") * F.col("successors")).alias("context_n"))
    pairs = bigram_counts(test).withColumnRenamed("n", "test_n")
    joined = (
        pairs.join(train_bigrams, ["context", "next"], "left")
        .join(ranks, ["context", "n"], "left").join(totals, "context", "left")
    )
    size = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    n = F.coalesce("n", F.lit(0))
    context_n = F.coalesce("context_n", F.lit(0))
    return joined.select(
        "context", "next", "test_n",
        ((n + alpha) / (context_n + size * alpha)).alias("p_true"),
        F.coalesce(F.col("rank"), F.lit(0)).alias("rank"),
    )


def _order_counts(train: DataFrame, order: int, test: DataFrame | None = None) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By order what the discount works on: ``(gram, n, wanted, trained)`` and per context ``(context, total, types)``.

    The highest order counts occurrences, a lower one continuations: in how
    many different longer contexts a token follows. Training is cut into tokens
    once: a lower order takes the different n-grams of the one above without
    their first token. For those at the start of a row the highest order has
    padded ones; they are ``trained``, but continue nothing. With a test part,
    its n-grams are among the rows (``n`` 0 if training has none), they and
    their ends are ``wanted``, and only contexts of wanted ones are kept. Each
    table is written once; what follows reads it instead of counting again.
    """
    gram = F.col("gram")
    rows = _grams(train, order, padded=True).select("gram", F.lit(1).alias("one"), F.lit(test is None).alias("wanted"))
    if test is not None:
        rows = rows.unionByName(_grams(test, order).select("gram", F.lit(0).alias("one"), F.lit(True).alias("wanted")))
    level = rows.groupBy("gram").agg(F.sum("one").alias("n"), F.max("wanted").alias("wanted"))
    level = level.withColumn("trained", F.col("n") > 0)
    tables = {}
    for k in range(order, 0, -1):
        level = stored(level, f"grams-{k}")
        whole = level.where(~gram.startswith(" "))
        totals = whole.groupBy(_context(gram, k).alias("context")).agg(
            F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("types"), F.max("wanted").alias("wanted")
        ).where("wanted and total > 0").select("context", "total", "types")
        tables[k] = whole, stored(totals, f"totals-{k}")
        if k > 1:
            level = level.groupBy(F.substring_index("gram", " ", 1 - k).alias("gram")).agg(
                F.count_if(F.col("trained") & ~gram.startswith(" ")).alias("n"),
                F.max("wanted").alias("wanted"), F.max("trained").alias("trained"),
            )
    return tables


def back_off_model(train: DataFrame, order: int, discount: float = DISCOUNT) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Interpolated discounting by order: ``(context, next, share)`` and ``(context, weight)``.

    ``share`` is what the discount leaves of a token in its context, ``weight``
    what it takes away from all of them, for the next lower order to give out.
    """
    model = {}
    for k, (grams, totals) in _order_counts(train, order).items():
        counts = grams.where("n > 0").select(_context(F.col("gram"), k).alias("context"), _next(F.col("gram")).alias("next"), "n")
        shares = counts.join(totals, "context").select(
            "context", "next", ((F.col("n") - discount) / F.col("total")).alias("share")
        )
        model[k] = shares, totals.select("context", (discount * F.col("types") / F.col("total")).alias("weight"))
    return model


def score_back_off(test: DataFrame, train: DataFrame, order: int = 3, discount: float = DISCOUNT) -> DataFrame:
    """Per distinct test n-gram ``(context, next, test_n)``: ``p_true`` by all orders up to ``order``.

    A context that training has not seen leaves everything to the next lower
    order; below the single tokens, all tokens of training and one unknown
    token are equally likely. The probabilities of a context add up to 1.
    Orders are put together from the lowest upwards, each for the wanted
    n-grams alone: tables of training are aggregated, but never joined whole.
    """
    tables = _order_counts(train, order, test)
    share = F.when(F.col("n") > 0, (F.col("n") - discount) / F.col("total")).otherwise(0.0)
    weight = F.coalesce(discount * F.col("types") / F.col("total"), F.lit(1.0))
    grams, totals = tables[1]  # one context: three numbers instead of a join
    size = grams.agg(F.count_if("trained").alias("size")).scalar()
    whole = totals.select(F.struct("total", "types")).scalar()
    words = unigram_counts(test).select(F.col("next").alias("gram"))
    scored = words.join(grams.select("gram", "n"), "gram", "left").withColumns(
        {"total": whole["total"], "types": whole["types"]}
    ).select("gram", (share + weight / (size + 1)).alias("p_true"))
    for k in range(2, order + 1):
        grams, totals = tables[k]
        rows = grams.where("wanted").select(
            "gram", "n", _context(F.col("gram"), k).alias("context"), F.substring_index("gram", " ", 1 - k).alias("end")
        )
        scored = rows.join(totals, "context", "left").join(scored.withColumnRenamed("gram", "end"), "end").select(
            "gram", (share + weight * F.col("p_true")).alias("p_true")
        )
    found = _grams(test, order).groupBy("gram").agg(F.count(F.lit(1)).alias("test_n")).join(scored, "gram")
    return found.select(_context(F.col("gram"), order).alias("context"), _next(F.col("gram")).alias("next"), "test_n", "p_true")


def score_summary(scored: DataFrame, k: int = 5) -> DataFrame:
    """Loss, perplexity and hit rates, weighted by occurrences."""
    n = F.col("test_n")
    loss = F.sum(-F.log("p_true") * n) / F.sum(n)

    def share(test: Column) -> Column:
        return F.sum(F.when(test, n).otherwise(0)) / F.sum(n)

    return scored.agg(
        F.sum(n).alias("n_pairs"),
        F.round(loss, 6).alias("loss"), F.round(F.exp(loss), 2).alias("perplexity"),
        F.round(share(F.col("rank") == 1), 6).alias("top1"),
        F.round(share(F.col("rank").between(1, k)), 6).alias("topk"),
    )
