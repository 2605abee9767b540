"""Operators for large training-data pipelines (text, vectors, media).

Nothing else in the package imports this subpackage.
"""
