"""Kilowave: Spark-native analytics of cumulative energy counters and training-text corpora."""
