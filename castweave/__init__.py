"""Castweave: a PySpark-native analytics engine for data about who appears with whom."""

__version__ = "0.1.0"
