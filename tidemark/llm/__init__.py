"""Operators for large-scale training data: sharding, tokenizing, scoring, deduplication, filtering.

Nothing else in the library imports this package. queries.py registers one query per operator.
"""
