"""Spindrift: a PySpark-native engine for exploring logs and preparing text corpora."""

__version__ = "0.1.0"
