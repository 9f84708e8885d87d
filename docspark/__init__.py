"""docspark: a PySpark-native engine for documents and for the work that reads them."""

__version__ = "0.1.0"
