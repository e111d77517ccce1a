"""chronofold: a PySpark-native engine for conversation and event timelines."""

__version__ = "0.1.0"
