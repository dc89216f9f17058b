"""Spark-native analytics for downhole, assay, grid and block-model tables."""
