"""Spark-native operators for investigating large bodies of structured records."""

__version__ = "0.1.0"
