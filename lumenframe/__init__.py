"""Spark-native analytics for collections of hyperspectral measurements."""

__version__ = "0.1.0"
