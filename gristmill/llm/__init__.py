"""Operators for training-text pipelines.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries with the driver entry module.
"""
