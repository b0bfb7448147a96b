"""Spark-native analytics for source-code quality data."""
