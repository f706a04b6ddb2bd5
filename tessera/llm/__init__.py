"""Operators that large training-data pipelines need.

Nothing outside this subpackage imports it; `queries.py` lists its queries and their SQL.
"""
