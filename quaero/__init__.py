"""A PySpark-native document search and retrieval engine."""

__version__ = "0.1.0"
