"""Vocabularies, word-level encoding and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import tokens as T
from corpusmill.operators import bpe, encode
from corpusmill.operators import vocab as W
from corpusmill.queries.base import Query, check, values
from corpusmill.queries.reports import PRE, WORDS
from corpusmill.sources import views as V

SPECIALS = bpe.PROFILES["gpt2"].specials
VOCAB_SIZE = bpe.PROFILES["gpt2"].vocab_size
PAD_ID = SPECIALS.index("[PAD]")
UNK_ID = SPECIALS.index("[UNK]")
TRIMMED_SIZES = (1000, 42_163)

PRE_ROWS = f"""
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_extract_all(content, '{PRE}') AS words FROM corpus) w"""
COUNTS = "SELECT word, count(*) AS freq FROM pre GROUP BY word"
VOCAB = f"""
    SELECT word AS token, CAST(ord AS INTEGER) AS id FROM {values(SPECIALS)} s(ord, word)
    UNION ALL SELECT word, CAST({len(SPECIALS) - 1} + row_number() OVER (ORDER BY freq DESC, word) AS INTEGER)
    FROM (SELECT * FROM counts ORDER BY freq DESC, word LIMIT {VOCAB_SIZE - len(SPECIALS)}) c"""
ENCODED = f"""
    SELECT c.doc_id, coalesce(list(coalesce(v.id, {UNK_ID}) ORDER BY pos) FILTER (pos IS NOT NULL), [])
           AS ids
    FROM corpus c LEFT JOIN pre p ON c.doc_id = p.doc_id LEFT JOIN vocab v ON p.word = v.token
    GROUP BY c.doc_id"""
_STEPS = {"pre": PRE_ROWS, "counts": COUNTS, "vocab": VOCAB, "encoded": ENCODED}


def _sql(select: str, upto: str = "encoded") -> str:
    names = list(_STEPS)
    return check("corpus", select, **{n: _STEPS[n] for n in names[: names.index(upto) + 1]})


def _text(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def _counts(spark, sf_dir):
    return W.pre_token_counts(V.corpus(spark, sf_dir))


def _vocab(spark, sf_dir):
    return W.word_vocabulary(_counts(spark, sf_dir), SPECIALS, VOCAB_SIZE)


def _encoded(spark, sf_dir):
    """Word-level ids per document, in order."""
    return encode.encode_corpus(V.corpus(spark, sf_dir), _word_level(spark, sf_dir))


def _word_level(spark, sf_dir):
    return encode.word_tokenizer(_vocab(spark, sf_dir), SPECIALS, VOCAB_SIZE)


def _ids(rule, name="ids"):
    def build(spark, sf_dir):
        return _encoded(spark, sf_dir).select(
            "doc_id", F.array_join(rule(F.col("input_ids")), " ").alias(name)
        )

    return build


def _batch_longest(side: str):
    def build(spark, sf_dir):
        cut = _encoded(spark, sf_dir).withColumn("input_ids", T.truncate(F.col("input_ids")))
        batched = W.longest_in_batch(cut, F.floor(F.col("doc_id") / 8).cast("bigint"))
        ids = T.pad(F.col("input_ids"), F.col("batch_longest"), PAD_ID, side)
        return batched.select("doc_id", "batch_id", F.array_join(ids, " ").alias("ids"))

    return build


_CUT = "list_slice(ids, 1, 512)"
_FILL = f"list_resize([]::INTEGER[], greatest(0, {{size}} - len({_CUT})), {PAD_ID})"
_FILL_512 = _FILL.format(size=512)
_LEFT = f"list_concat({_FILL_512}, {_CUT})"
_RIGHT = f"list_concat({_CUT}, {_FILL_512})"


def _batch_sql(side: str) -> str:
    fill = _FILL.format(size="longest")
    padded = f"list_concat({fill}, {_CUT})" if side == "left" else f"list_concat({_CUT}, {fill})"
    return _sql(f"""SELECT doc_id, batch_id, {_text(padded)} AS ids FROM (
        SELECT *, max(len({_CUT})) OVER (PARTITION BY doc_id // 8) AS longest,
               doc_id // 8 AS batch_id FROM encoded) b""")


def _inputs(spark, sf_dir):
    padded = encode.model_inputs(_encoded(spark, sf_dir), PAD_ID)
    return padded.select(
        "doc_id", F.array_join("attention_mask", " ").alias("mask"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("n_real"),
    )


def _labels(spark, sf_dir):
    padded = encode.model_inputs(_encoded(spark, sf_dir), PAD_ID)
    return padded.select("doc_id", F.array_join("labels", " ").alias("labels"))


def _shifted(spark, sf_dir):
    """Per document the inputs and, one to the left, the token to predict at each place."""
    ids = T.truncate(F.col("input_ids"))
    shifted = _encoded(spark, sf_dir).select("doc_id", T.shifted_labels(ids).alias("labels"))
    return shifted.select("doc_id", F.array_join("labels", " ").alias("labels"))


def _word_decoded(spark, sf_dir):
    return encode.decode_corpus(_encoded(spark, sf_dir), _word_level(spark, sf_dir))


def _evaluated(spark, sf_dir):
    """The word-level tokenizer: a known word is one token, others unknown."""
    return encode.evaluate_tokenizer(V.corpus(spark, sf_dir), _word_level(spark, sf_dir))


_EVALUATED = f"""
SELECT round((u - o) / u, 6) AS vocab_coverage, round((u - od) / u, 6) AS vocab_coverage_distinct,
       mean_token_count, median_token_count, round(o / w, 6) AS oov_rate,
       round(s / w, 6) AS subword_fragmentation
FROM (SELECT count(*) AS u, sum(n) AS w, coalesce(sum(n) FILTER (bad), 0) AS o,
             count(*) FILTER (bad) AS od, coalesce(sum(n) FILTER (n_sub > 1), 0) AS s
      FROM (SELECT word, any_value(n) AS n, count(*) AS n_sub, bool_or(v.id IS NULL) AS bad
            FROM (SELECT word, n, unnest(regexp_extract_all(word, '{PRE}')) AS piece FROM
                  (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM corpus) x
                   GROUP BY word) f) p
            LEFT JOIN vocab v ON p.piece = v.token GROUP BY word) k) t,
     (SELECT round(avg(len(ids)), 6) AS mean_token_count,
             quantile_cont(len(ids), 0.5) AS median_token_count FROM encoded) m"""


def _lookup(spark, sf_dir):
    """Ids of the words of the benchmark items, unknown ones included."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = items.select(F.explode(T.pre_tokens(F.col("text"))).alias("token")).distinct()
    return W.token_ids(words, _vocab(spark, sf_dir), UNK_ID)


QUERIES = {
    "X1_pre_tokens": Query(
        lambda spark, d: W.pre_token_rows(V.corpus(spark, d)).select(
            "doc_id", F.col("pos").cast("bigint").alias("pos"), "word"
        ),
        _sql("SELECT doc_id, pos, word FROM pre", "pre"),
    ),
    "X2_word_counts": Query(_counts, _sql("SELECT word, freq FROM counts", "counts")),
    "X3_alphabet": Query(
        lambda spark, d: W.alphabet(_counts(spark, d)).select("char", "n"),
        _sql("""SELECT char, CAST(sum(freq) AS BIGINT) AS n FROM (
                  SELECT unnest(string_split(word, '')) AS char, freq FROM counts) c
                GROUP BY char ORDER BY n DESC, char LIMIT 1000""", "counts"),
    ),
    "X4_pair_counts": Query(
        lambda spark, d: W.pair_counts(_counts(spark, d)),
        _sql("""SELECT word[i] AS left, word[i + 1] AS right, CAST(sum(freq) AS BIGINT) AS n
                FROM (SELECT word, freq, unnest(generate_series(1, length(word) - 1)) AS i FROM counts) c
                GROUP BY ALL HAVING sum(freq) >= 2""", "counts"),
    ),
    "X7_special_tokens_first": Query(_vocab, _sql("SELECT token, id FROM vocab", "vocab")),
    "X8_encode_words": Query(
        _ids(lambda ids: ids), _sql(f"SELECT doc_id, {_text('ids')} AS ids FROM encoded")
    ),
    "X9_decode_words": Query(
        _word_decoded,
        _sql(f"""SELECT c.doc_id, coalesce(string_agg(coalesce(v.token, '{SPECIALS[UNK_ID]}'), ' '
                     ORDER BY pos) FILTER (pos IS NOT NULL), '') AS text
                 FROM corpus c LEFT JOIN pre p ON c.doc_id = p.doc_id LEFT JOIN vocab v ON p.word = v.token
                 GROUP BY c.doc_id""", "vocab"),
    ),
    "X10_truncate": Query(_ids(T.truncate), _sql(f"SELECT doc_id, {_text(_CUT)} AS ids FROM encoded")),
    "X11_left_pad": Query(
        _ids(lambda ids: T.pad(T.truncate(ids), T.MAX_LENGTH, PAD_ID)),
        _sql(f"SELECT doc_id, {_text(_LEFT)} AS ids FROM encoded"),
    ),
    "X11_left_pad_batch_longest": Query(_batch_longest("left"), _batch_sql("left")),
    "X11b_right_pad": Query(
        _ids(lambda ids: T.pad(T.truncate(ids), T.MAX_LENGTH, PAD_ID, "right")),
        _sql(f"SELECT doc_id, {_text(_RIGHT)} AS ids FROM encoded"),
    ),
    "X11b_right_pad_batch_longest": Query(_batch_longest("right"), _batch_sql("right")),
    "X12_attention_mask": Query(
        _inputs,
        _sql(f"""SELECT doc_id, {_text("mask")} AS mask, CAST(coalesce(list_sum(mask), 0) AS INTEGER) AS n_real
              FROM (SELECT doc_id, list_transform({_LEFT}, lambda i: CASE WHEN i <> {PAD_ID} THEN 1 ELSE 0 END)
                    AS mask FROM encoded) m"""),
    ),
    "X13_labels": Query(_labels, _sql(f"SELECT doc_id, {_text(_LEFT)} AS labels FROM encoded")),
    "X13_shifted_labels": Query(
        _shifted,
        _sql(f"""SELECT doc_id, CASE WHEN len({_CUT}) = 0 THEN ''
                   ELSE {_text(f"list_concat(list_slice({_CUT}, 2, 512), [-100])")} END AS labels
                 FROM encoded"""),
    ),
    "X14_evaluate_words": Query(_evaluated, _sql(_EVALUATED)),
    "X15_trimmed_coverage": Query(
        lambda spark, d: W.trimmed_coverage(_counts(spark, d), TRIMMED_SIZES),
        _sql("""SELECT CAST(k AS BIGINT) AS vocab_size, CAST(sum(freq) FILTER (r <= k) AS BIGINT) AS covered,
                  count(*) AS n_words, round(sum(freq) FILTER (r <= k) / sum(freq), 6) AS coverage
                FROM (SELECT freq, row_number() OVER (ORDER BY freq DESC, word) AS r FROM counts) c,
                     (VALUES (1000), (42163)) v(k) GROUP BY k""", "counts"),
    ),
    "X15_trimmed_vocabulary": Query(
        lambda spark, d: W.word_vocabulary(_counts(spark, d), SPECIALS, TRIMMED_SIZES[-1]),
        _sql(f"SELECT token, id FROM vocab WHERE id < {TRIMMED_SIZES[-1]}", "vocab"),
    ),
    "X16_vocab_lookup": Query(
        _lookup,
        _sql(f"""SELECT t.token, coalesce(v.id, {UNK_ID}) AS id FROM (
                  SELECT DISTINCT unnest(regexp_extract_all(text, '{PRE}')) AS token FROM benchmark) t
                LEFT JOIN vocab v ON t.token = v.token""", "vocab"),
    ),
    "X16_vocab_size": Query(
        lambda spark, d: W.vocab_size(_vocab(spark, d)),
        _sql("SELECT count(*) AS size, CAST(min(id) AS BIGINT) AS min_id, "
             "CAST(max(id) AS BIGINT) AS max_id FROM vocab", "vocab"),
    ),
}
