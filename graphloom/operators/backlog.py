"""Work lists of the enrichment loops, and the updates that shorten them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import blank, usable_features
from graphloom.model import PropertyGraph
from graphloom.operators.upsert import set_properties


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy("id").limit(limit)


def unextracted(graph: PropertyGraph, limit: int | None = None) -> DataFrame:
    """Functions with a location and no descriptors yet."""
    rows = graph.labelled("Function").where(
        "atomic_features is null and file is not null and start_line is not null"
    )
    return _limited(rows.select("id", "name", "file", "start_line", "end_line"), limit)


def unembedded(graph: PropertyGraph, limit: int | None = None) -> DataFrame:
    rows = graph.labelled("Function", "Feature").where("embedding is null")
    return _limited(rows.select("id", "name", "file", "atomic_features"), limit)


def unnamed(graph: PropertyGraph, limit: int | None = None) -> DataFrame:
    rows = graph.labelled("Feature", "Domain").where(blank(F.col("name")) | blank(F.col("description")))
    return _limited(rows.select("id", "label", "name", "description"), limit)


def counted(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("count"))


def embeddings_only(graph: PropertyGraph) -> DataFrame:
    """Vectors of features, and of production functions with usable descriptors."""
    production = ~F.coalesce("is_test", F.lit(False)) & usable_features(F.col("atomic_features"))
    wanted = (F.col("label") == "Feature") | ((F.col("label") == "Function") & production)
    return graph.nodes.where(wanted & F.col("embedding").isNotNull()).select("id", "embedding")


def function_metadata(graph: PropertyGraph) -> DataFrame:
    production = ~F.coalesce("is_test", F.lit(False)) & usable_features(F.col("atomic_features"))
    return (
        graph.labelled("Function")
        .where(production)
        .select("id", "name", "file", "start_line", "end_line", "atomic_features")
    )


def update_atomic_features(graph: PropertyGraph, updates: DataFrame) -> PropertyGraph:
    """Set ``(id, atomic_features, is_volatile)`` on functions."""
    return set_properties(graph, updates.select("id", "atomic_features", "is_volatile"), ("Function",))


def update_embeddings(graph: PropertyGraph, updates: DataFrame) -> PropertyGraph:
    return set_properties(graph, updates.select("id", "embedding"))


def update_summaries(graph: PropertyGraph, updates: DataFrame) -> PropertyGraph:
    """Set ``(id, name, description)`` on features and domains."""
    return set_properties(graph, updates.select("id", "name", "description"), ("Feature", "Domain"))
