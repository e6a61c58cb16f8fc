"""A PySpark-native engine for ordered conversation data."""
