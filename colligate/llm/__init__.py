"""Operators for preparing large-scale training data, as Spark jobs.

Nothing else in the library imports this subpackage; it imports nothing from
the rest either, so that either part works without the other.
"""
