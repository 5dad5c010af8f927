"""Operators of a training-data pipeline: one module each, queries in ``registry``.

Nothing outside this subpackage imports it.
"""
