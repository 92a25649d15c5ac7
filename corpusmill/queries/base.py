"""Registry helpers: a query is a Spark function and, where it exists, SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources import views as V

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    """A numbered list of words as rows ``(ord, word)``."""
    return "(VALUES " + ", ".join(f"({i}, {quoted(w)})" for i, w in enumerate(words)) + ")"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


CHECK_VIEWS = {
    "corpus": V.CORPUS,
    "vcorpus": V.VCORPUS,
    "varcorpus": V.VARCORPUS.format(
        joined="(SELECT string_agg('VAR' || i || repeat(' ', 1 + p_partkey % 12), '' ORDER BY i) "
        "FROM generate_series(1, p_size * 5) g(i))"
    ),
    "predictions": """
        SELECT 'a' AS model_id, vec_id // 10 AS batch_id, vec_id AS pos, label,
               embedding AS logits
        FROM embeddings""",
    "two_models": """
        SELECT model_id, vec_id // 10 AS batch_id, vec_id AS pos, label,
               CASE WHEN model_id = 'a' THEN embedding ELSE list_reverse(embedding) END AS logits
        FROM embeddings, (VALUES ('a'), ('b')) m(model_id)""",
    "run_log": f"""
        SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS INTEGER)
               AS epoch
        FROM ({V.RUN_LOG}) log""",
}


def check(views: str, select: str, **steps: str) -> str:
    """SQL text: the named views and steps as common tables, then a SELECT."""
    tables = {name: CHECK_VIEWS[name] for name in views.split()} | steps
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in tables.items())
    return f"WITH {ctes}\n{select}"
