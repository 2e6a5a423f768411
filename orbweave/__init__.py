"""Spark-native analytics for geospatial imagery, sensor messages and text corpora."""

__version__ = "0.1.0"
