"""Spark-native processing of ordered, nested item and document collections."""
