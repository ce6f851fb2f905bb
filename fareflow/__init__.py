"""Spark-native analytics over trips, weather, city events and places."""
