"""Declared schemas; no stage relies on inference."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STRING, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

CORPUS = _struct(
    ("doc_id", LONG), ("repo_name", STRING), ("path", STRING), ("size", LONG),
    ("content", STRING), ("license", STRING),
)
FLAGGED = T.StructType(
    CORPUS.fields
    + _struct(
        ("remove_flag", T.BooleanType()), ("coq_flag", T.BooleanType()),
        ("reason_code", STRING), ("reason_detail", STRING),
        ("coq_keywords", T.ArrayType(STRING)),
    ).fields
)
ANONYMIZED = T.StructType(CORPUS.fields + _struct(("split", STRING)).fields)
RULES = _struct(
    ("rule_set", STRING), ("ord", INT), ("pattern", STRING), ("kind", STRING),
    ("flags", STRING),
)
VOCAB = _struct(("token", STRING), ("id", INT))
MERGES = _struct(("rank", INT), ("left", STRING), ("right", STRING))
TOKENS = _struct(
    ("doc_id", LONG), ("input_ids", T.ArrayType(INT)),
    ("attention_mask", T.ArrayType(INT)), ("labels", T.ArrayType(INT)),
)
PREDICTIONS = _struct(
    ("model_id", STRING), ("batch_id", LONG), ("pos", LONG), ("label", INT),
    ("logits", T.ArrayType(T.FloatType())),
)
RUN_LOG = _struct(
    ("run", STRING), ("epoch", INT), ("step", INT), ("batch_size", INT),
    ("learning_rate", DOUBLE), ("weight_decay", DOUBLE), ("warmup_steps", INT),
    ("loss", DOUBLE), ("composite", DOUBLE),
)
