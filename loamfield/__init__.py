"""Loamfield: a PySpark-native analytics engine for corpora of text entries and their metadata."""

__version__ = "0.1.0"
