"""Spark-native analytics for dynamic evaluation of code generation models."""
