"""lectern: a Spark-native analytics and retrieval engine for document libraries."""

__version__ = "0.1.0"
