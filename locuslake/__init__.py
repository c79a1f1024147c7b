"""Spark-native fine-mapping analytics."""
