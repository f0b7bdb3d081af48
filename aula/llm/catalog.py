"""All queries of this subpackage with their SQL."""

from __future__ import annotations

from aula.llm import leakage_queries, look_alike_queries, near_duplicates_queries, nearest_time_queries, packing_queries, page_repair_queries, splitting_queries, term_counts_queries

MODULES = (splitting_queries, page_repair_queries, nearest_time_queries, term_counts_queries, near_duplicates_queries, packing_queries, leakage_queries, look_alike_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
