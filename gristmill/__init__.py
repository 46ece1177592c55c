"""gristmill: a Spark-native engine that refines text corpora into verified, leakage-safe datasets."""

__version__ = "0.1.0"
