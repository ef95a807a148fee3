"""Positional text search and text-index analytics on PySpark."""
