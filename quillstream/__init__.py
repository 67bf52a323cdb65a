"""Spark-native analytics for citation impact and training-data preparation."""
