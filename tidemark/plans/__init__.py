"""Operators put together: layer views and the batch runs that fill the tables."""
