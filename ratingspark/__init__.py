"""Spark-native curation, rating and agreement toolkit for rated text corpora."""

__version__ = "0.1.0"
