"""Operators for large training-data pipelines, and the queries that apply them.

Each module holds one operator; ``queries`` registers one query for each.
Nothing outside this subpackage imports it.
"""
