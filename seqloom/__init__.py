"""seqloom: a PySpark-native engine for ordered numeric sequences and event tables."""

__version__ = "0.1.0"
