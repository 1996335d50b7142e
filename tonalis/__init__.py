"""Spark-native analytics of music and other time series."""
