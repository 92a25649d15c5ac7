"""The registered queries of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import (
    chunk_dedup,
    decontaminate,
    filter_audit,
    langid,
    licenses,
    mixing,
    near_dedup,
    periodic_runs,
    pii,
    quality,
    secret_scan,
    url_rules,
    warc,
)
from corpusmill.queries.base import Query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP1_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes
    FROM pages),
h AS (SELECT html, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN holder IS NULL OR holder IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(holder, page_id) AS refers_to
FROM p LEFT JOIN h USING (html)
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
    FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id
           AND row_number() OVER (PARTITION BY norm, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=4)


OP4_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))
        END) AS shingle
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- a linked pair meets in the first shingles of each by rarity
r AS (
    SELECT doc_id, shingle, n,
           row_number() OVER (PARTITION BY doc_id ORDER BY df, shingle) AS place
    FROM s JOIN n USING (doc_id) JOIN (SELECT shingle, count(*) AS df FROM s GROUP BY shingle) USING (shingle)),
p AS (SELECT * FROM r WHERE place <= n - (80 * n + 99) // 100 + 1),
c AS (
    SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb
    FROM p x JOIN p y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
i AS (
    SELECT a, b, na, nb, count(*) AS met
    FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.shingle = x.shingle
    GROUP BY ALL),
e AS (
    SELECT a, b FROM i WHERE 100 * met >= 80 * (na + nb - met)
    UNION ALL
    SELECT b, a FROM i WHERE 100 * met >= 80 * (na + nb - met)),
reach AS (
    SELECT a AS doc_id, b AS other FROM e
    UNION
    SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles,
       least(doc_id, coalesce(other, doc_id)) AS component_id,
       doc_id <= coalesce(other, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_scan(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, ranking)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


OP8_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents),
q AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark),
t AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size,
           unnest(list_transform(range(1, greatest(2, len(words) - 8)),
                                 lambda i: array_to_string(words[i:i+9], ' '))) AS window_text
    FROM q WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM t),
d AS (
    SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS place, words
    FROM w, sizes WHERE len(words) >= size),
f AS (
    SELECT d.doc_id, place, d.size, item_id
    FROM (SELECT doc_id, place, size, array_to_string(words[place:place + size - 1], ' ') AS window_text FROM d) d
    JOIN t ON t.size = d.size AND t.window_text = d.window_text),
h AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM f) GROUP BY doc_id),
m AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""



def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH RECURSIVE r(verdict, host, path) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
l AS (
    SELECT url, unnest([
        regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>'),
                       '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
        regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>'),
                       '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)]) AS target
    FROM pages),
a AS (
    SELECT url, replace(target, '&amp;', '&') AS target,
           regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme,
           regexp_extract(url, '(?s)^.*?://[^/?#]*') AS site,
           regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder
    FROM l WHERE target != ''),
t AS (
    SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
                     WHEN target LIKE '//%' THEN scheme || ':' || target
                     WHEN target LIKE '/%' THEN site || target
                     ELSE site || CASE folder WHEN '' THEN '/' ELSE folder END || target END AS target
    FROM a),
u AS (SELECT url FROM pages WHERE contains(url, '://') UNION SELECT target FROM t WHERE contains(target, '://')),
k AS (
    SELECT url,
           translate(regexp_extract(url, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
               || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS key,
           translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM u),
j AS (
    SELECT url, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(verdict, len(r.host || r.path)) AS verdict
    FROM k JOIN r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
    GROUP BY url),
e AS (
    SELECT x.key AS a, y.key AS b FROM t JOIN k x ON x.url = t.url JOIN k y ON y.url = t.target
    UNION SELECT y.key, x.key FROM t JOIN k x ON x.url = t.url JOIN k y ON y.url = t.target),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
s AS (
    SELECT a AS key, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS bad
    FROM reach JOIN k ON k.key = reach.b JOIN j ON j.url = k.url GROUP BY a)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN bad THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN k ON k.url = pages.url LEFT JOIN j ON j.url = pages.url LEFT JOIN s ON s.key = k.key
"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
o AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
marks AS (
    SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
    FROM labels GROUP BY doc_id),
m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           [CAST(f AS INTEGER) FOR f IN [
               len(words) < 50,
               100 * list_unique(words) < 65 * len(words),
               100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
               regexp_matches(text, '[#$%&*|]'),
               coalesce(doc_id > first_id, false)]] AS fails
    FROM d JOIN o USING (text) LEFT JOIN marks USING (doc_id)),
c AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
letters(letter, place) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
           [a.place, b.place, c.place, d.place, e.place] AS places
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.place, b.place, c.place, d.place, e.place])) = 5),
steps AS (
    SELECT filter_order, step, places[step] AS place, places[1:step - 1] AS before
    FROM orders, range(1, 6) s(step)),
t AS (
    SELECT part, filter_order, step, place, n, good, toxic,
           fails[place] = 1 AS fails_it,
           list_sum([0] || [fails[p] FOR p IN before]) > 0 AS gone,
           list_sum(fails) = 1 AS only_one
    FROM c, steps),
r AS (
    SELECT part, filter_order, step, place,
           sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN only_one AND fails_it THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS toxic_lost
    FROM t GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley
FROM r
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.learn(docs))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents")).drop("n_words", "n_dropped")


OP13_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           -- CRC-32 of the decimal digits, a bit at a time
           xor(4294967295, list_reduce(
               [CAST(4294967295 AS BIGINT)] || flatten([[-CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]
                                                        FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
               lambda c, x: CASE WHEN x < 0 THEN xor(c, -x)
                                 ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END)) AS h
    FROM documents),
g AS (SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS planted, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (
    SELECT doc_id, n, CASE WHEN planted
        THEN [words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] FOR i IN range(n)] ELSE words END AS words
    FROM p),
-- a run's words q apart are equal for 6 words at least
s AS (
    SELECT doc_id, n, unnest(range(n - 5)) AS i,
           unnest(list_transform(range(1, n - 4), lambda j: hash(array_to_string(words[j:j + 5], ' ')))) AS six
    FROM w WHERE n >= 12),
e AS (
    SELECT x.doc_id, x.n, x.i, y.i - x.i AS q
    FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
f AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e),
r AS (
    SELECT doc_id, min(i) AS start, q, max(i) + q + 6 - min(i) AS length
    FROM f GROUP BY doc_id, q, stretch HAVING max(i) + q + 6 - min(i) >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
best AS (
    SELECT doc_id, count(*) AS n_runs,
           string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
           arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS top
    FROM runs GROUP BY doc_id),
cover AS (
    SELECT doc_id, list(DISTINCT i) AS gone
    FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY doc_id),
kept AS (
    SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM w) w
    LEFT JOIN (SELECT doc_id, unnest(gone) AS i, true AS dropped FROM cover) c USING (doc_id, i)
    WHERE dropped IS NULL GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period,
       1000 * top.length // top.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


QUERIES = {
    "op1_warc": Query(op1, OP1_SQL),
    "op2_secrets": Query(op2),
    "op3_exact_dedup": Query(op3, OP3_SQL),
    "op4_near_dedup": Query(op4, OP4_SQL),
    "op5_mixing": Query(op5),
    "op6_licences": Query(op6),
    "op7_quality": Query(op7),
    "op8_decontamination": Query(op8, OP8_SQL),
    "op9_url_rules": Query(op9, OP9_SQL),
    "op10_language": Query(op10),
    "op11_filter_audit": Query(op11, OP11_SQL),
    "op12_personal_data": Query(op12),
    "op13_periodic_runs": Query(op13, OP13_SQL),
}
