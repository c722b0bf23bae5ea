"""Operators for training-data pipelines over the ``documents``-style tables.

Nothing else in the library imports this subpackage; it imports only general
helpers (session settings) from the rest.
"""
