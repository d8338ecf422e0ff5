"""Spark-native search for periodic dips in evenly sampled time series."""
