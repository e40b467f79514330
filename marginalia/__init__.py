"""Spark-native analytics for curated text corpora."""
