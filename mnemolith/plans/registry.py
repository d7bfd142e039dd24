"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

from . import log_queries, page_queries, surface_queries

_ALL = log_queries.QUERIES | page_queries.QUERIES | surface_queries.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
