"""Operators for training-data pipelines.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
