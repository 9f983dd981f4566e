"""A PySpark-native engine for privacy-aware synthetic text data."""
