"""Spark-native analytics for ordered sporting events, market prices and player performance."""
