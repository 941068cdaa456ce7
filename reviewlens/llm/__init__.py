"""Operators of a training-data pipeline over raw documents, pages and vectors.

Nothing else in the library imports this subpackage. Each operator module has a
general interface; ``queries`` holds the thin registered queries over the
driver's tables and their DuckDB SQL.
"""
