"""Spark-native analytics for moving objects."""

__version__ = "0.1.0"
