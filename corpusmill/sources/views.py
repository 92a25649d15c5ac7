"""Views of the given tables that stand in for the curation inputs.

Each view is one portable SELECT (only functions with the same meaning in
Spark SQL and ANSI engines), so a check in another engine sees the same rows.
All views are per-row projections. Texts built from ``part`` deal its narrow
rows out first; nothing else shuffles unless the session asks (see ``spread``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.staging import evaluate_once
from corpusmill.operators.ranking import rank_within
from corpusmill.sources.corpus import SPREAD, spread

LF = "chr(10)"
CRLF = "chr(13) || chr(10)"

CORPUS = """
SELECT doc_id,
       source AS repo_name,
       lang || '/' || cast(doc_id AS string) || CASE doc_id % 4
           WHEN 0 THEN '.v' WHEN 1 THEN '.sv' WHEN 2 THEN '.txt' ELSE '.vhd' END AS path,
       n_chars AS size,
       text AS content,
       CASE WHEN contains(text, 'Apache License') THEN 'apache-2.0'
            WHEN contains(text, 'MIT License') THEN 'mit'
            WHEN contains(text, 'GNU General Public License') THEN 'gpl-3.0'
            WHEN contains(text, 'CC BY-NC') THEN 'cc-by-nc-4.0'
            ELSE 'none' END AS license
FROM documents
"""


def _lines(*items: str) -> str:
    return f" || {LF} || ".join(items)


def _header(name: str, size: str = "sz") -> str:
    return (
        f"'module ' || {name} || ' #(parameter W=' || {size} || ')(input clk, "
        f"input [7:0] data_in, output reg out_' || {size} || ');'"
    )


def _body(size: str = "sz") -> list[str]:
    return [
        f"'/* size ' || {size}",
        "'two lines */'",
        "'always @(posedge clk)'",
        "'begin'",
        f"'if (data_in > 8''d' || {size} || ') out_' || {size} || ' = 1;'",
        f"'else out_' || {size} || ' = 0; // alt'",
        "'end'",
        f"'sub_' || {size} || ' u' || {size} || '(.clk(clk));'",
    ]


_TOP = ["'`timescale 1ns/1ps'", "'// ' || p_type || ' part'"]
_END = "'endmodule'"
_PLAIN = _header("unit_name")


def _unit(*planted: str, header: str = _PLAIN, end: str = _END) -> str:
    return _lines(*_TOP, header, *planted, *_body(), end)


_PLANTED = {
    2: _unit(header="'module m' || id || ' .'"),
    5: _lines(*_TOP, *_body()),
    6: _unit("CASE WHEN floor(p_partkey / 20) % 2 = 0 THEN 'Lemma x : y.' ELSE 'Theorem x : y.' END"),
    7: _unit("'assign checksum = data_in;'"),
    8: _unit("'$display(\"x\");'", "'#5 out = 1;'", "'#50'"),
    9: _unit("'initial begin'", "'a = 1;'", "'end'"),
    10: _unit("'specify'", "'(a => b) = 1;'", "'endspecify'"),
    11: _unit(end=_lines("'always @(negedge clk)'", "'begin'", "'w = 1;'", _END)),
    13: _unit("'(* keep *) wire w;'"),
    14: _unit(end=_lines(_END, "'// tail'")),
    15: _lines(
        "'`timescale 1ns/1ps'", "'// STANDARD part'", _header("'copied_unit'", "'7'"),
        *_body("'7'"), _END,
    ),
    16: _lines(
        *_TOP, _PLAIN, *_body(), "'leaf_' || id || ' u$clk(.clk(clk));'",
        "'leaf_' || id || ' v$clk(.clk(clk));'", "'leaf_' || id || ' core0(.clk(clk));'",
        _END, "'module leaf_' || id || ' (input clk);'", _END,
    ),
    17: _unit("'include \"x.vh\"'", "'pragma once'", "'a ='"),
    18: _unit(
        "'wire foo_bar, foobar, VAR3, sim;'", "'assign foo_bar = 8''hFF;'",
        "'assign foobar = 4''b01;'", "'sim = 1;'",
    ),
}

_CONTENT = "\n            ".join(f"WHEN {k} THEN {v}" for k, v in _PLANTED.items())

VCORPUS = f"""
SELECT id_number AS doc_id,
       repo_name,
       path,
       cast(coalesce(length(content), 0) AS bigint) AS size,
       content,
       license
FROM (
    SELECT p_partkey AS id_number,
           p_brand AS repo_name,
           CASE kind WHEN 1 THEN 'coq/' || id || '.v'
                     WHEN 3 THEN 'rtl/tb/' || id || '.v'
                     WHEN 4 THEN 'rtl/simple_' || id || '.v'
                     ELSE 'rtl/' || id || '.v' END AS path,
           CASE p_partkey % 4 WHEN 0 THEN 'mit' WHEN 1 THEN 'apache-2.0'
                WHEN 2 THEN 'bsd-3-clause' ELSE 'gpl-3.0' END AS license,
           CASE kind WHEN 0 THEN NULL
            WHEN 12 THEN replace({_unit()}, {LF}, {CRLF})
            {_CONTENT}
            ELSE {_unit()} END AS content
    FROM (
        SELECT p_partkey, p_brand, p_type,
               p_partkey % 20 AS kind,
               cast(p_partkey AS string) AS id,
               cast(p_size AS string) AS sz,
               replace(p_name, ' ', '_') || '_' || cast(p_partkey AS string) AS unit_name
        FROM part
    ) parts
) units
"""

# Text dense in placeholders; string-building differs per engine only in the
# function that joins a generated list, which the caller supplies.
VARCORPUS = """
SELECT p_partkey AS doc_id,
       p_brand AS repo_name,
       'rtl/' || cast(p_partkey AS string) || '.v' AS path,
       CASE WHEN p_partkey % 50 = 0 THEN ''
            WHEN p_partkey % 25 = 5 THEN 'VAR' || cast(p_size AS string)
            ELSE {joined} END AS content,
       CASE WHEN p_partkey % 10 = 0 THEN 'test'
            WHEN p_partkey % 10 = 1 THEN 'validation' ELSE 'train' END AS split
FROM part
"""
VARCORPUS_SPARK = VARCORPUS.format(
    joined="array_join(transform(sequence(1, p_size * 5), "
    "i -> concat('VAR', i, repeat(' ', cast(1 + p_partkey % 12 AS int)))), '')"
)

PREDICTIONS_SPARK = """
SELECT 'a' AS model_id, cast(floor(vec_id / 10) AS bigint) AS batch_id, vec_id AS pos, label,
       embedding AS logits
FROM embeddings
"""
TWO_MODELS_SPARK = """
SELECT model_id, cast(floor(vec_id / 10) AS bigint) AS batch_id, vec_id AS pos, label,
       CASE model_id WHEN 'a' THEN embedding ELSE reverse(embedding) END AS logits
FROM embeddings
LATERAL VIEW explode(array('a', 'b')) models AS model_id
"""

# A training log per user: every event is one epoch of the user's run, and
# one step of the day it falls on.
RUN_LOG = """
SELECT cast(user_id AS string) AS run,
       event_id, ts,
       cast(year(ts) * 1000 + dayofyear(ts) AS int) AS day,
       CASE WHEN event_type = 'view' THEN 'validation' ELSE 'train' END AS phase,
       CASE WHEN user_id % 2 = 0 THEN 4 ELSE 8 END AS batch_size,
       cast(CASE WHEN floor(user_id / 2) % 2 = 0 THEN 0.00005 ELSE 0.00003 END AS double)
           AS learning_rate,
       cast(CASE WHEN floor(user_id / 4) % 2 = 0 THEN 0.01 ELSE 0.001 END AS double)
           AS weight_decay,
       CASE WHEN floor(user_id / 8) % 2 = 0 THEN 500 ELSE 1000 END AS warmup_steps,
       value AS loss,
       value / 1000 AS composite
FROM events
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(
    spark: SparkSession, sf_dir: str, table: str, sql: str, key: str | None = None
) -> DataFrame:
    source = _table(spark, sf_dir, table)
    rows = spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=source)
    return spread(rows, key) if key else rows


def _built(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows whose text is built from the narrow rows of ``part``.

    A row of a few bytes becomes a text that long chains of rules run over, so
    the size of the scan says nothing about the work: a table that is read in
    one task would be worked on in one. The narrow rows are dealt out one by
    one, also where keys repeat, before any text is built; the text is put
    together once per row, however many rules and filters look at it.
    """
    source = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    usual = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = source.repartition(int(spark.conf.get(SPREAD, None) or usual))
    return evaluate_once(spark.sql(sql.replace("FROM part", "FROM {source}"), source=source), "content")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", CORPUS, "doc_id")


def vcorpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, VCORPUS)


def varcorpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, VARCORPUS_SPARK)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", PREDICTIONS_SPARK)


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", TWO_MODELS_SPARK)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs numbered per run; a busy run is ranked hour by hour."""
    rows = _view(spark, sf_dir, "events", RUN_LOG)
    hour = F.year("ts") * 100000 + F.dayofyear("ts") * 100 + F.hour("ts")
    ranked = rank_within(rows, "run", hour, "ts", "event_id")
    return ranked.withColumn("epoch", F.col("rank").cast("int")).drop("rank")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _table(spark, sf_dir, "pages")
    return spread(source, "page_id")
