"""Spark-native data-quality analytics: profile, clean, check and record evidence about tables and texts."""

__version__ = "0.1.0"
