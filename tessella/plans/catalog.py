"""All registered queries and their SQL statements."""

from __future__ import annotations

from . import graph_queries, search_queries, text_queries

MODULES = (graph_queries, search_queries, text_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "rag_query"
