"""Spark-native masking, audit and training-data engine."""
