"""All registered queries."""

from graphloom.plans import build_queries, enrich_queries, graph_queries, source_queries, store_queries, vector_queries  # noqa: F401
from graphloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
