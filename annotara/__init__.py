"""annotara: a PySpark-native analytics engine for annotated text corpora."""

__version__ = "0.1.0"
