"""Spark-native analytics over engineering data, records and rules."""
