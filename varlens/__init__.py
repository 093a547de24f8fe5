"""varlens: a Spark-native engine for functional analysis of variance on large tables."""

__version__ = "0.1.0"
