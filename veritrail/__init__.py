"""Spark-native analytics over evidence-centred scientific data."""
