"""Operators for preparing training data: one module per operator, their named queries in ``queries.py``."""
