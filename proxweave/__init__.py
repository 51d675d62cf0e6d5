"""Spark-native proximity-graph analytics."""

__version__ = "0.1.0"
