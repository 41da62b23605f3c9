"""Spark-native analytics over corpora of per-function source text."""
