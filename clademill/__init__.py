"""Sequence-collection analytics on PySpark."""
