"""Training, encoding and decoding with learnt merges, and the same in recursive SQL.

The profiles are trained on the whole benchmark table, each to its own size or
until no pair is left, and the corpus is encoded with what they learnt. One
profile is trained on all documents too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import bpe, encode
from corpusmill.operators import vocab as W
from corpusmill.queries.base import Query, check, listed
from corpusmill.queries.reports import PRE, WORDS
from corpusmill.sources import views as V


def trained(spark, sf_dir, name: str) -> bpe.Tokenizer:
    """One profile, trained on the items of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = items.select(F.col("item_id").alias("doc_id"), F.col("text").alias("content"))
    return bpe.train(W.pre_token_counts(texts), bpe.PROFILES[name])


def trained_on_documents(spark, sf_dir: str) -> bpe.Tokenizer:
    """The GPT-2 profile, trained on all documents; SQL would need hours, so tests use a brute-force trainer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.train(W.pre_token_counts(docs.select("doc_id", F.col("text").alias("content"))), bpe.PROFILES["gpt2"])


# --- the trainer in SQL: the word list rides in one row, a merge is a replace ---


def _spelled(profile: bpe.Profile, c: str = "c") -> str:
    return (
        f"CASE WHEN i > 1 THEN '{profile.prefix}' ELSE '' END || {c} "
        f"|| CASE WHEN i = n THEN '{profile.suffix}' ELSE '' END"
    )


def _train(profile: bpe.Profile) -> dict[str, str]:
    limit = f"LIMIT {profile.limit_alphabet}" if profile.limit_alphabet else ""
    rest = f"CASE WHEN starts_with(r, '{profile.prefix}') THEN r[{len(profile.prefix) + 1}:] ELSE r END"
    return {
        "b_counts": f"""
    SELECT word, count(*) AS freq FROM (
        SELECT unnest(regexp_extract_all(text, '{PRE}')) AS word FROM benchmark) b GROUP BY word""",
        "b_chars": """
    SELECT word, freq, unnest(string_split(word, '')) AS c,
           generate_subscripts(string_split(word, ''), 1) AS i, length(word) AS n FROM b_counts""",
        "b_alphabet": f"SELECT c FROM b_chars GROUP BY c ORDER BY sum(freq) DESC, c {limit}",
        "b_spelled": f"SELECT *, {_spelled(profile)} AS symbol FROM b_chars JOIN b_alphabet USING (c)",
        "b_first": f"""
    SELECT list_concat({listed(profile.specials)}, list_concat(
        (SELECT list(c ORDER BY c) FROM b_alphabet),
        coalesce((SELECT list(symbol ORDER BY symbol) FROM (
            SELECT DISTINCT symbol FROM b_spelled WHERE symbol NOT IN (FROM b_alphabet)) s), []))) AS tokens""",
        "b_ids": "SELECT unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM b_first",
        "b_coded": """
    SELECT word, any_value(freq) AS freq, string_agg(chr(CAST(255 + place AS INTEGER)), '' ORDER BY i) AS codes
    FROM b_spelled JOIN b_ids ON symbol = token GROUP BY word""",
        "train": f"""
    SELECT 0 AS step, list(codes ORDER BY word) AS words, list(freq ORDER BY word) AS freqs,
           (SELECT tokens FROM b_first) AS tokens, '' AS pair, '' AS code, '' AS l, '' AS r
    FROM b_coded
    UNION ALL
    SELECT step + 1, list_transform(words, lambda w: replace(w, best, made)), freqs,
           CASE WHEN known IS NULL THEN list_append(tokens, merged) ELSE tokens END, best, made, l, r
    FROM (SELECT step, words, freqs, tokens, best, l, r, l || {rest} AS merged,
                 list_position(tokens, l || {rest}) AS known,
                 chr(CAST(255 + coalesce(list_position(tokens, l || {rest}), len(tokens) + 1) AS INTEGER)) AS made
          FROM (SELECT t.step, t.words, t.freqs, t.tokens, b.best,
                       t.tokens[unicode(b.best[1]) - 255] AS l, t.tokens[unicode(b.best[2]) - 255] AS r
                FROM train t, LATERAL (
                    SELECT w[i:i + 1] AS best, sum(f) AS n
                    FROM (SELECT unnest(t.words) AS w, unnest(t.freqs) AS f) u,
                         LATERAL (SELECT unnest(range(1, length(w))) AS i) p
                    GROUP BY best HAVING sum(f) >= {max(1, profile.min_frequency)}
                    ORDER BY n DESC, best LIMIT 1) b
                WHERE len(t.tokens) < {profile.vocab_size}) x) y""",
        "learnt": "SELECT tokens FROM train ORDER BY step DESC LIMIT 1",
        "ids": """
    SELECT token, CAST(place - 1 AS INTEGER) AS id
    FROM (SELECT unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM learnt) t""",
    }


def _pieces(profile: bpe.Profile) -> dict[str, str]:
    """``pieces(word, place, id)`` of every distinct pre-token of the corpus."""
    words = {
        "words": f"""
    SELECT DISTINCT unnest(regexp_extract_all(content, '{PRE}')) AS word FROM corpus""",
    }
    if profile.kind == "wordpiece":
        return words | {
            "spans": f"""
    SELECT word, i, e, t.id FROM (
        SELECT word, i, unnest(range(i, least(length(word), i + 120) + 1)) AS e FROM (
            SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words
            WHERE length(word) <= {profile.max_word_chars}) a) b
    JOIN ids t ON t.token = CASE WHEN i > 1 THEN '{profile.prefix}' ELSE '' END || word[i:e]""",
            "longest": "SELECT word, i, max(e) AS e, arg_max(id, e) AS id FROM spans GROUP BY word, i",
            "walk": """
    SELECT word, 0 AS e, CAST(NULL AS INTEGER) AS id, 0 AS place FROM words
    UNION ALL
    SELECT w.word, l.e, l.id, w.place + 1 FROM walk w JOIN longest l ON l.word = w.word AND l.i = w.e + 1""",
            "whole": "SELECT word, max(e) = length(word) AS ok FROM walk GROUP BY word",
            "pieces": f"""
    SELECT word, place, id FROM walk JOIN whole USING (word) WHERE ok AND place > 0
    UNION ALL SELECT word, 1, (SELECT id FROM ids WHERE token = '{profile.unknown}') FROM whole WHERE NOT ok""",
        }
    return words | {
        "merges": "SELECT pair, min(step) AS rank, arg_min(code, step) AS code FROM train WHERE step > 0 GROUP BY pair",
        "start": f"""
    SELECT word, string_agg(chr(256 + coalesce(t.id, (SELECT id FROM ids WHERE token = '{profile.unknown}'))),
                            '' ORDER BY i) AS codes
    FROM (SELECT word, i, {_spelled(profile)} AS symbol FROM (
              SELECT word, unnest(string_split(word, '')) AS c,
                     generate_subscripts(string_split(word, ''), 1) AS i, length(word) AS n FROM words) a) b
    LEFT JOIN ids t ON t.token = b.symbol GROUP BY word""",
        "enc": """
    SELECT word, codes, 0 AS k FROM start
    UNION ALL
    SELECT word, codes[:best.i - 1] || best.code || codes[best.i + 2:], k + 1
    FROM (SELECT e.word, e.codes, e.k, arg_min({'i': e.i, 'code': m.code}, m.rank * 1000000 + e.i) AS best
          FROM (SELECT word, codes, k, unnest(range(1, length(codes))) AS i FROM enc) e
          JOIN merges m ON m.pair = e.codes[e.i:e.i + 1] GROUP BY e.word, e.codes, e.k) x""",
        "pieces": """
    SELECT word, place, CAST(unicode(codes[place]) - 256 AS INTEGER) AS id
    FROM (SELECT word, codes, unnest(range(1, length(codes) + 1)) AS place
          FROM (SELECT word, arg_max(codes, k) AS codes FROM enc GROUP BY word) l) p""",
    }


_DOCS = {
    "per_word": "SELECT word, list(id ORDER BY place) AS ids FROM pieces GROUP BY word",
    "encoded": f"""
    SELECT c.doc_id, coalesce(flatten(list(p.ids ORDER BY pos) FILTER (pos IS NOT NULL)), []) AS ids
    FROM corpus c LEFT JOIN (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(content, '{PRE}') AS w FROM corpus) x) o ON o.doc_id = c.doc_id
    LEFT JOIN per_word p ON p.word = o.word GROUP BY c.doc_id""",
}


def _sql(name: str, select: str, pieces: bool = False) -> str:
    profile = bpe.PROFILES[name]
    steps = _train(profile) | ((_pieces(profile) | _DOCS) if pieces else {})
    return check("corpus", select, **steps).replace("WITH", "WITH RECURSIVE", 1)


# --- Spark side -----------------------------------------------------------


def _merges(name: str) -> Query:
    def build(spark, sf_dir):
        return trained(spark, sf_dir, name).merge_table(spark)

    return Query(build, _sql(name, "SELECT CAST(step - 1 AS INTEGER) AS rank, l AS left, r AS right FROM train WHERE step > 0"))


def _vocabulary(name: str) -> Query:
    def build(spark, sf_dir):
        return trained(spark, sf_dir, name).vocab(spark)

    return Query(build, _sql(name, "SELECT token, id FROM ids"))


def _encoding(name: str) -> Query:
    def build(spark, sf_dir):
        encoded = encode.encode_corpus(V.corpus(spark, sf_dir), trained(spark, sf_dir, name))
        return encoded.select(
            "doc_id", F.size("input_ids").alias("n_tokens"),
            F.array_join("input_ids", " ").alias("ids"),
        )

    return Query(build, _sql(
        name, "SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, array_to_string(ids, ' ') AS ids FROM encoded", True
    ))


def _decoded(spark, sf_dir):
    tokenizer = trained(spark, sf_dir, "mistral")
    return encode.decode_corpus(encode.encode_corpus(V.corpus(spark, sf_dir), tokenizer), tokenizer)


_DECODED = """
SELECT e.doc_id, coalesce(string_agg(t.token, ' ' ORDER BY place) FILTER (place IS NOT NULL), '') AS text
FROM encoded e LEFT JOIN (
    SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM encoded) u ON u.doc_id = e.doc_id
LEFT JOIN ids t ON t.id = u.id GROUP BY e.doc_id"""


def _evaluated(spark, sf_dir):
    return encode.evaluate_tokenizer(V.corpus(spark, sf_dir), trained(spark, sf_dir, "gpt2"))


_EVALUATED = f"""
SELECT round((u - o) / u, 6) AS vocab_coverage, round((u - od) / u, 6) AS vocab_coverage_distinct,
       mean_token_count, median_token_count, round(o / w, 6) AS oov_rate,
       round(s / w, 6) AS subword_fragmentation
FROM (SELECT count(*) AS u, sum(n) AS w, coalesce(sum(n) FILTER (bad), 0) AS o, count(*) FILTER (bad) AS od,
             coalesce(sum(n) FILTER (n_sub > 1), 0) AS s
      FROM (SELECT f.word, any_value(n) AS n, sum(len(p.ids)) AS n_sub,
                   bool_or(list_contains(p.ids, (SELECT id FROM ids WHERE token = '[UNK]'))) AS bad
            FROM (SELECT word, n, unnest(regexp_extract_all(word, '{PRE}')) AS piece FROM
                  (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM corpus) x
                   GROUP BY word) g) f
            JOIN per_word p ON p.word = f.piece GROUP BY f.word) k) t,
     (SELECT round(avg(len(ids)), 6) AS mean_token_count,
             quantile_cont(len(ids), 0.5) AS median_token_count FROM encoded) m"""

QUERIES = {
    "X5_train_bpe_mistral": _merges("mistral"),
    "X5_train_bpe_gemma": _merges("gemma"),
    "X5_train_bpe_llama": _vocabulary("llama"),
    "X5_train_bpe_gpt2": _vocabulary("gpt2"),
    "X5_train_on_documents": Query(lambda spark, sf_dir: trained_on_documents(spark, sf_dir).vocab(spark)),
    "X6_train_wordpiece": _vocabulary("bert"),
    "X6_encode_wordpiece": _encoding("bert"),
    "X8_encode_bpe": _encoding("gpt2"),
    "X9_decode_bpe": Query(_decoded, _sql("mistral", _DECODED, True)),
    "X14_evaluate_bpe": Query(_evaluated, _sql("gpt2", _EVALUATED, True)),
}
