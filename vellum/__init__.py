"""vellum: Spark-native analytics for research literature."""

__version__ = "0.1.0"
