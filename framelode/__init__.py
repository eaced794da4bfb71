"""Spark-native analytics over annotation datasets and per-frame sequence records."""
