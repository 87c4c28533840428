"""A PySpark-native analytics engine for single-molecule data."""
