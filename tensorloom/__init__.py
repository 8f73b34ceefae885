"""Spark-native analytics for n-dimensional numeric data."""

__version__ = "0.1.0"
