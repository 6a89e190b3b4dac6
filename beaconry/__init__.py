"""Beaconry: a PySpark-native engine for discovery over code, documents and tables."""
