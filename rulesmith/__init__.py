"""Spark-native discovery and maintenance of dependency rules."""
