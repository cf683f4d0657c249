"""Spark-native analytics over knowledge and evidence tables."""
