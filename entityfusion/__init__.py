"""A PySpark-native engine for multi-source entity fusion."""

__version__ = "0.1.0"
