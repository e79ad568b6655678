"""quillmark: a Spark-native engine for hybrid retrieval over labelled text notes."""

__version__ = "0.1.0"
