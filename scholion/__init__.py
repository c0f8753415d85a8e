"""Spark-native analytics over a scholarly document corpus."""
