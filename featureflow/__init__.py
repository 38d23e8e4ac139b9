"""Spark-native tabular-ML data pipeline operators."""
