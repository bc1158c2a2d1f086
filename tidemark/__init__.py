"""Tidemark: market and operations analytics as plain PySpark DataFrame operators."""
