"""Moraine: a PySpark-native log-structured key-value engine."""
