"""Literal and vector search, alone and combined."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine_score, is_zero, norm, vector_literal
from graphloom.model import PropertyGraph


def _hybrid(nodes: DataFrame, literal: Column, vector: Sequence[float] | None, limit: int, index: Any = None, probes: int | None = None) -> DataFrame:
    """Literal hits score 1; vector hits score their similarity; the better one counts.

    With an ``index`` over these nodes (``vector_index.VectorIndex``) only some of its cells are read for the vector.
    """
    exact = nodes.where(literal).select("id", "label", F.lit(1.0).alias("score"))
    if not is_zero(vector):
        query = vector_literal(vector)
        near = index.nearest(vector, limit, probes) if index is not None else (
            nodes.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0))
            .select("id", "label", cosine_score(F.col("embedding"), query).alias("score"))
            .orderBy(F.desc("score"), "id")
            .limit(limit)
        )
        exact = exact.orderBy("id").limit(limit)
        exact = exact.unionByName(near).groupBy("id").agg(F.max("label").alias("label"), F.max("score").alias("score"))
    return exact.orderBy(F.desc("score"), "id").limit(limit)


def search_similar(graph: PropertyGraph, query: str, vector: Sequence[float] | None = None, limit: int = 10, index: Any = None, probes: int | None = None) -> DataFrame:
    """Functions whose id, fqn or name is ``query``, whose name starts so, or that are near."""
    col = F.col
    literal = (col("name") == query) | (col("id") == query) | (col("fqn") == query) | col("name").startswith(query)
    return _hybrid(graph.labelled("Function"), literal, vector, limit, index, probes)


def search_features(graph: PropertyGraph, query: str, vector: Sequence[float] | None = None, limit: int = 10, index: Any = None, probes: int | None = None) -> DataFrame:
    """Features whose id or name is ``query``, whose name contains it, or that are near."""
    literal = (F.col("name") == query) | (F.col("id") == query) | F.col("name").contains(query)
    return _hybrid(graph.labelled("Feature"), literal, vector, limit, index, probes)


def search_all(graph: PropertyGraph, query: str, vector: Sequence[float] | None = None, limit: int = 10, functions: Any = None, features: Any = None, probes: int | None = None) -> DataFrame:
    """Functions and features in one ranking; each may have an index."""
    both = search_similar(graph, query, vector, limit, functions, probes).unionByName(search_features(graph, query, vector, limit, features, probes))
    return both.orderBy(F.desc("score"), "id").limit(limit)
