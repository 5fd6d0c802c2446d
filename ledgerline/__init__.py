"""Spark-native layered analytics on nested JSON and parquet data."""
