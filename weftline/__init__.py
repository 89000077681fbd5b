"""Spark-native analytics over conversation traces and label-efficient classification studies."""

__version__ = "0.1.0"
