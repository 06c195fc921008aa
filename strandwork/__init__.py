"""Spark-native engine for sequence and directed-graph data."""
