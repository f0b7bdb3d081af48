"""All queries of the core with their SQL."""

from __future__ import annotations

from aula.plans import index_queries, interval_queries, lecture_queries, search_queries, verify_queries

MODULES = (index_queries, interval_queries, lecture_queries, search_queries, verify_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
