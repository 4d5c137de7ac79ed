"""Tidewell: a PySpark-native analytics engine for large multi-tenant tables."""

__version__ = "0.1.0"
