"""A PySpark-native incremental analytics engine."""

__version__ = "0.1.0"
