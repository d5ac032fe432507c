"""Spark-native analytics for water-level series, gridded terrain and flood frequency."""
