"""A PySpark-native engine for append-only operation logs."""
