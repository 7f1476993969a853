"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. ``catalog`` lists the
queries; each operator has a module of its own.
"""
