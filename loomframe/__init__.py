"""Spark-native analytics for item, provenance and training-data tables."""
