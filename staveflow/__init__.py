"""staveflow: a PySpark-native engine for page-layout and object-annotation tables."""

__version__ = "0.1.0"
