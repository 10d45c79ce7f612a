"""Spark-native text-quality analytics: scorers are Columns or DataFrame transforms."""
