"""Ferrule: a Spark-native engine for content that has already been fetched."""
