"""Spark-native analytics for tiled volumes, experiment tables and text corpora."""
