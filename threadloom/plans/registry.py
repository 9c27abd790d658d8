"""All registered queries by name."""

from __future__ import annotations

from . import catalog_queries, graph_queries, search_queries, store_queries

QUERIES = {**graph_queries.QUERIES, **search_queries.QUERIES, **catalog_queries.QUERIES, **store_queries.QUERIES}
