"""Spark-native engine that turns crawled pages and documents into consolidated, provenance-tracked records."""
