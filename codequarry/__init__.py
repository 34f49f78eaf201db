"""Spark-native analytics over source-code audit data."""
