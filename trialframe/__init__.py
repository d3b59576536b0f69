"""Spark-native analysis of longitudinal controlled experiments."""
