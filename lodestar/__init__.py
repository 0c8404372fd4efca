"""Spark-native collections of vectors: filtered exact and approximate top-k search, ordered mutations, evaluation."""
