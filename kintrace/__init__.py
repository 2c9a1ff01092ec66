"""Spark-native entity-family resolution and corpus preparation."""
