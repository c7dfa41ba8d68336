"""marlspar: a PySpark-native engine for posting-style record data."""
