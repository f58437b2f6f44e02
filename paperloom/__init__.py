"""paperloom: a PySpark-native engine for office-document packages."""

__version__ = "0.1.0"
