"""Spark-native corpus analytics: web pages and documents to a searchable, de-duplicated training corpus."""
