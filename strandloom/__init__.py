"""Spark-native sequence and interval analytics."""
