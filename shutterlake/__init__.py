"""Spark-native metadata analytics over media files."""
