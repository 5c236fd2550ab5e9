"""lexloom: Spark-native text curation and minimal-pair analytics."""

__version__ = "0.1.0"
