"""Spark-native record linkage and corpus processing."""
