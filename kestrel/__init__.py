"""Kestrel: a Spark-native document graph and retrieval engine."""
