"""Emberline: a Spark-native analytics engine."""
