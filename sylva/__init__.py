"""Spark-native analytics over source trees."""
