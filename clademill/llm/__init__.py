"""Operators for large-scale training-text preparation.

Nothing else in the library imports this subpackage.
"""
