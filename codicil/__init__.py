"""Spark-native analytics for versioned corpora of legal documents."""

__version__ = "0.1.0"
