"""Spark-native curation of source-code corpora."""
