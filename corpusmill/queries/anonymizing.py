"""Identifier anonymisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import rules as R
from corpusmill.functions import identifiers as I
from corpusmill.operators import anonymize as A
from corpusmill.operators import clean
from corpusmill.queries.base import Query, check, listed
from corpusmill.queries.cleaning import CODE
from corpusmill.sources import views as V

# --- the same rules in SQL: word runs, unnest, windows ---------------------

_WORDS = listed(dict.fromkeys(R.MEANINGFUL_WORDS))
_RESERVED = listed(R.reserved_identifiers())
_RUN = "[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+"
_PROTECTED = f"list_has_any(string_split(x, '$'), {_WORDS})"
SOURCE = "SELECT doc_id, code FROM code_all WHERE present"
CODE_ALL = """SELECT c.doc_id, c.code, v.content IS NOT NULL AS present
    FROM code_raw c JOIN vcorpus v ON c.doc_id = v.doc_id"""
STRIP = f"""
    SELECT doc_id, coalesce(list_aggregate(list_transform(regexp_extract_all(code, '{_RUN}'),
        lambda x: CASE WHEN {_PROTECTED} THEN x ELSE replace(replace(x, '_', ''), '$', '') END),
        'string_agg', ''), '') AS code FROM source"""
NAMED = r"""
    SELECT doc_id, CASE WHEN len(mods) = 0 THEN 'module dummymodule(' || chr(10) || code ELSE code END
           AS code, CASE WHEN len(mods) = 0 THEN ['dummymodule'] ELSE mods END AS mods
    FROM (SELECT *, regexp_extract_all(code, '\bmodule\s+\\?([_a-zA-Z$][\w$]*)', 1) AS mods
          FROM strip) s"""
IDENTS = """
    SELECT doc_id, x AS name, place FROM (
        SELECT doc_id, unnest(runs) AS x, generate_subscripts(runs, 1) AS place
        FROM (SELECT doc_id, regexp_extract_all(code, '[A-Za-z0-9_$]+') AS runs FROM named) r) u
    WHERE regexp_matches(x, '^[_a-zA-Z]')"""
LITERALS = r"""
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(code,
        '''(d[0-9]+|b[01]+|o[0-7]+|h[0-9a-fA-F]+)', 1)) AS name FROM named"""
MODULES = """
    SELECT doc_id, name, min(place) AS place FROM (
        SELECT doc_id, unnest(mods) AS name, generate_subscripts(mods, 1) AS place FROM named) m
    GROUP BY ALL"""
# Runs and gaps alternate, so an instance is a run two places after its module.
INSTANCES = f"""
    SELECT r2.doc_id, r2.x AS name, min(r2.place) AS place
    FROM runs r0 JOIN runs r1 ON r0.doc_id = r1.doc_id AND r1.place = r0.place + 1
    JOIN runs r2 ON r0.doc_id = r2.doc_id AND r2.place = r0.place + 2
    JOIN modules m ON m.doc_id = r0.doc_id AND m.name = r0.x
    WHERE regexp_matches(r1.x, '^\\s+$') AND regexp_matches(r2.x, '^[_a-zA-Z$]')
      AND NOT list_contains({_RESERVED}, r2.x)
      AND NOT EXISTS (SELECT 1 FROM modules o WHERE o.doc_id = r2.doc_id AND o.name = r2.x)
    GROUP BY ALL"""
RUNS = f"""
    SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS place
    FROM (SELECT doc_id, regexp_extract_all(code, '{_RUN}') AS parts FROM named) p"""
VARIABLES = f"""
    SELECT DISTINCT doc_id, name FROM idents i
    WHERE NOT list_contains({_RESERVED}, name) AND NOT list_contains({_WORDS}, name)
      AND NOT EXISTS (SELECT 1 FROM literals l WHERE l.doc_id = i.doc_id AND l.name = i.name)
      AND NOT EXISTS (SELECT 1 FROM modules m WHERE m.doc_id = i.doc_id AND m.name = i.name)
      AND NOT EXISTS (SELECT 1 FROM instances s WHERE s.doc_id = i.doc_id AND s.name = i.name)"""
KEPT = f"""
    SELECT doc_id, name, word || CASE WHEN n + taken = 0 THEN '' ELSE CAST(n + taken AS VARCHAR) END
           AS replacement
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY kind, place) - 1 AS n,
                 CASE WHEN EXISTS (SELECT 1 FROM idents o WHERE o.doc_id = b.doc_id
                     AND o.name = b.word) THEN 1 ELSE 0 END AS taken
          FROM (SELECT *, list_filter(string_split(name, '$'),
                    lambda p: list_contains({_WORDS}, p))[1] AS word FROM both_kinds) b
          WHERE word IS NOT NULL AND word <> name) k"""
BOTH = """SELECT doc_id, 'module' AS kind, name, place FROM modules
    UNION ALL SELECT doc_id, 'submodule', name, place FROM instances"""
RENAMES = f"""
    SELECT doc_id, kind, name, prefix || row_number() OVER (PARTITION BY doc_id, kind
           ORDER BY sha256('42:' || doc_id || ':' || name)) AS replacement
    FROM (SELECT doc_id, kind, name, upper(kind) AS prefix FROM both_kinds
          UNION ALL SELECT doc_id, 'variable', name, 'VAR' FROM variables) n
    WHERE NOT list_contains({_WORDS}, name)
      AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = n.doc_id AND k.name = n.name)
    UNION ALL SELECT doc_id, 'kept', name, replacement FROM kept"""
REWRITTEN = """
    SELECT r.doc_id, string_agg(coalesce(n.replacement, r.x), '' ORDER BY r.place) AS code
    FROM runs r LEFT JOIN renames n ON n.doc_id = r.doc_id AND n.name = r.x GROUP BY r.doc_id"""
RESIDUAL = f"""
    SELECT DISTINCT doc_id, name FROM (
        SELECT doc_id, unnest(regexp_extract_all(code, '[A-Za-z0-9_$]+')) AS name FROM rewritten) u
    WHERE regexp_matches(name, '^[_a-zA-Z]')
      AND NOT list_contains({listed(R.VERILOG_KEYWORDS)}, name) AND NOT list_contains({_WORDS}, name)
      AND NOT EXISTS (SELECT 1 FROM renames n WHERE n.doc_id = u.doc_id AND n.replacement = u.name)
      AND NOT EXISTS (SELECT 1 FROM literals l WHERE l.doc_id = u.doc_id AND l.name = u.name)"""
BANNED = f"""
    SELECT *, list_contains({listed(dict.fromkeys(R.NON_SYNTHESIZABLE_WORDS + R.PATH_KEYWORDS))}, name)
        AS banned FROM residual"""
RELEASED = """
    SELECT w.doc_id, coalesce(string_agg(name, '|' ORDER BY name) FILTER (banned), '') AS banned,
           coalesce(string_agg(name, '|' ORDER BY name) FILTER (NOT banned), '') AS aberrant,
           list(name) FILTER (banned) AS banned_list, any_value(w.code) AS code
    FROM rewritten w LEFT JOIN banned b ON w.doc_id = b.doc_id GROUP BY w.doc_id"""
COLLIDED = """
    SELECT doc_id FROM renames GROUP BY doc_id HAVING count(DISTINCT replacement) < count(*)
    UNION SELECT r.doc_id FROM renames r JOIN idents i ON i.doc_id = r.doc_id AND i.name = r.replacement
    WHERE NOT EXISTS (SELECT 1 FROM renames x WHERE x.doc_id = i.doc_id AND x.name = i.name)"""
FINAL = """
    SELECT doc_id, banned, aberrant,
           CASE WHEN doc_id IN (SELECT doc_id FROM collided) THEN 'RENAME_COLLISION'
                WHEN aberrant <> '' THEN 'ABERRANT_IDENTIFIER' END AS quarantine,
           CASE WHEN banned_list IS NULL THEN code ELSE list_aggregate(list_transform(
               string_split(code, chr(10)), lambda x: CASE WHEN len(list_filter(banned_list,
                   lambda w: contains(x, w))) > 0 THEN '' ELSE x END), 'string_agg', chr(10)) END
           AS content
    FROM released"""
_ORDER = {
    "code_raw": CODE, "code_all": CODE_ALL, "source": SOURCE, "strip": STRIP, "named": NAMED,
    "idents": IDENTS, "literals": LITERALS, "modules": MODULES, "runs": RUNS,
    "instances": INSTANCES, "variables": VARIABLES, "both_kinds": BOTH, "kept": KEPT,
    "renames": RENAMES, "rewritten": REWRITTEN, "residual": RESIDUAL, "banned": BANNED,
    "released": RELEASED, "collided": COLLIDED, "final": FINAL,
}


# The same steps on cleaned text.
ON_CLEANED = {"source": "SELECT doc_id, content AS code FROM cleaned"} | {
    name: body for name, body in _ORDER.items() if name not in ("code_raw", "code_all", "source")
}


def _sql(select: str, upto: str) -> str:
    names = list(_ORDER)
    steps = {name: _ORDER[name] for name in names[: names.index(upto) + 1]}
    return check("vcorpus", select, **steps)


# --- Spark side -----------------------------------------------------------


def source(spark, sf_dir):
    """Comment-free code of the files that have content."""
    rows = V.vcorpus(spark, sf_dir).filter("content IS NOT NULL")
    return clean.code_text(rows).select("doc_id", "path", "size", F.col("code").alias("content"))


def _names(columns):
    return lambda spark, d: A.extract_names(source(spark, d)).select("doc_id", *columns())


def _joined(column: str):
    return F.array_join(F.sort_array(column), "|").alias(column)


def _content(rule):
    return lambda spark, d: source(spark, d).select(
        "doc_id", rule(F.col("content")).alias("content")
    )


def _renames(spark, sf_dir):
    return A.rename_rows(source(spark, sf_dir))


def _anonymized(spark, sf_dir):
    return A.anonymize(source(spark, sf_dir))


def _long(column: str):
    return lambda spark, d: A.extract_names(source(spark, d)).select(
        "doc_id", F.explode(column).alias("name")
    )


def _kept(spark, sf_dir):
    return _renames(spark, sf_dir).filter("kind = 'kept'").select("doc_id", "name", "replacement")


def _meaningful(spark, sf_dir):
    named = A.extract_names(source(spark, sf_dir))
    kept = F.array_distinct(I.within("identifiers", R.MEANINGFUL_WORDS))
    return named.select("doc_id", F.explode(kept).alias("name"))


def _bijection(spark, sf_dir):
    """Over all kinds together: as many replacements as names."""
    return _renames(spark, sf_dir).groupBy("doc_id").agg(
        F.count_distinct("name").alias("n_names"),
        F.count_distinct("replacement").alias("n_replacements"),
    )


def _quarantine(spark, sf_dir):
    return A.quarantined(_anonymized(spark, sf_dir)).select(
        "doc_id", "quarantine", F.array_join(F.sort_array("aberrant"), "|").alias("aberrant")
    )


def _empty_guard(spark, sf_dir):
    return A.extract_names(source(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("id_count") == 0).alias("n_empty"),
        F.min("id_count").alias("min_ids"), F.max("id_count").alias("max_ids"),
    )


def _compare(spark, sf_dir):
    before = source(spark, sf_dir)
    return A.compare_sample(before, A.anonymize(before), 20)


QUERIES = {
    "N1_strip_underscores": Query(
        _content(I.strip_underscores),
        _sql("SELECT doc_id, replace(replace(code, '_', ''), '$', '') AS content FROM source",
             "source"),
    ),
    "P5_strip_underscores_except": Query(
        _content(I.strip_underscores_except),
        _sql("SELECT doc_id, code AS content FROM strip", "strip"),
    ),
    "N2_module_names": Query(
        _names(lambda: [F.array_join("module_names", "|").alias("module_names"), "code"]),
        _sql("""SELECT n.doc_id, any_value(n.code) AS code,
                       string_agg(m.name, '|' ORDER BY m.place) AS module_names
                FROM named n JOIN modules m ON n.doc_id = m.doc_id GROUP BY n.doc_id""", "modules"),
    ),
    "N3_identifier_counts": Query(
        _names(lambda: [
            "id_count",
            F.size(F.array_distinct("identifiers")).cast("bigint").alias("n_distinct"),
        ]),
        _sql("SELECT doc_id, count(*) AS id_count, count(DISTINCT name) AS n_distinct FROM idents "
             "GROUP BY doc_id", "idents"),
    ),
    "N4_renameable_identifiers": Query(
        _long("variable_names"), _sql("SELECT doc_id, name FROM variables", "variables")
    ),
    "N5_number_texts": Query(
        _long("literals"), _sql("SELECT doc_id, name FROM literals", "literals")
    ),
    "N6_meaningful_identifiers": Query(
        _meaningful,
        _sql(f"SELECT DISTINCT doc_id, name FROM idents WHERE list_contains({_WORDS}, name)", "idents"),
    ),
    "N7_submodule_names": Query(
        _long("submodule_names"), _sql("SELECT doc_id, name FROM instances", "instances")
    ),
    "N8_meaningful_renames": Query(
        _kept, _sql("SELECT doc_id, name, replacement FROM kept", "kept")
    ),
    "N9_placeholder_map": Query(
        _renames, _sql("SELECT doc_id, kind, name, replacement FROM renames", "renames")
    ),
    "N10_rename_runs": Query(
        lambda spark, d: A.rewrite(source(spark, d)).select("doc_id", F.col("code").alias("content")),
        _sql("SELECT doc_id, code AS content FROM rewritten", "rewritten"),
    ),
    "N11_bijection": Query(
        _bijection,
        _sql("SELECT doc_id, count(DISTINCT name) AS n_names, count(DISTINCT replacement) "
             "AS n_replacements FROM renames GROUP BY doc_id", "renames"),
    ),
    "N12_aberrant_identifiers": Query(
        lambda spark, d: _anonymized(spark, d).select(
            "doc_id", "content", _joined("banned"), _joined("aberrant"), "quarantine"
        ),
        _sql("SELECT doc_id, content, banned, aberrant, quarantine FROM final", "final"),
    ),
    "N12_quarantine": Query(
        _quarantine,
        _sql("SELECT doc_id, quarantine, aberrant FROM final WHERE quarantine IS NOT NULL", "final"),
    ),
    "N13_empty_identifier_guard": Query(
        _empty_guard,
        _sql("""SELECT count(*) AS n_docs, count(*) FILTER (n = 0) AS n_empty, min(n) AS min_ids,
                       max(n) AS max_ids
                FROM (SELECT s.doc_id, count(i.name) AS n FROM named s LEFT JOIN idents i
                      ON s.doc_id = i.doc_id GROUP BY s.doc_id) c""", "idents"),
    ),
    "N14_compare_sample": Query(
        _compare,
        _sql("""SELECT f.doc_id, s.code AS original_content, f.content
                FROM final f JOIN source s ON f.doc_id = s.doc_id
                WHERE f.doc_id IN (SELECT doc_id FROM source
                                   ORDER BY sha256('42:' || doc_id), doc_id LIMIT 20)""", "final"),
    ),
}
