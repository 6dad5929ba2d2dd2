"""Spark-native analytics for time series and text."""
