"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``queries`` derives the registered digest queries from them.
"""
