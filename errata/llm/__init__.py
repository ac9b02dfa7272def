"""Operators for training-data pipelines, one module each.

Nothing else in the package imports this subpackage.
"""
