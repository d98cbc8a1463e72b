"""A PySpark-native engine for content-addressed, evidence-aware analytics."""
