"""Spark-native curation of entity catalogs."""
