"""Spark-native analytics over time-synchronised video comments."""

__version__ = "0.1.0"
