"""Operators for large-scale training-data pipelines, one module each.

Nothing outside this subpackage imports it; ``queries.py`` holds the query
registry and ``oracle.py`` the SQL that checks it.
"""
