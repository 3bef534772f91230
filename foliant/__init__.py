"""foliant: a PySpark-native engine for structuring, validating and deduplicating text records."""
