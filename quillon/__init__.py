"""Spark-native document structuring, chunking, vector search and question sets."""
