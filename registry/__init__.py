"""Queries over the given tables, each with its equivalent SQL."""

from registry import balance_queries, loading, messy

_MODULES = (balance_queries, messy, loading)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
