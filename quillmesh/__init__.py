"""Spark-native analytics for document corpora, code graphs and change history."""
