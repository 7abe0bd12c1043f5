"""Spark-native analytics engine for public-expense and neighbourhood statistics."""
