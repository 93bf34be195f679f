"""Spark-native analytics over long, irregular measurement data."""
