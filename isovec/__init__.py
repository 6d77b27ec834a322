"""isovec: a PySpark-native vector-search analytics engine."""

__version__ = "0.1.0"
