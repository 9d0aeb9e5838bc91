"""Spark-native analytics for source-code corpora."""
