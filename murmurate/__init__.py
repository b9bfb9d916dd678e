"""Murmurate: Spark-native evaluation analytics for speech and language systems."""
