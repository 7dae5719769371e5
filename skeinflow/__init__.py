"""Spark-native operators for phasing reads and untangling assembly graphs."""
