"""Spark-native analytics over point clouds and building wireframes."""

__version__ = "0.1.0"
