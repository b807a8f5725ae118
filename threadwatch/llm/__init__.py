"""Operators for large-scale training-data preparation.

Nothing outside this package imports it.  Each ``opN`` module holds one operator
with a general interface; ``queries`` holds the registered thin queries.
"""
