"""Spark-native change-data replication analytics and training-data operators."""
