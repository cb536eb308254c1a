"""One-hop and bounded neighbourhood questions about a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.lookup import resolve_ids
from graphloom.operators.reach import reach_again, steps


def _into(graph: PropertyGraph, node, edge_type: str) -> DataFrame:
    """Ids of the sources of ``edge_type`` edges that end on the named nodes."""
    targets = resolve_ids(graph, node).select(F.col("id").alias("dst"))
    return graph.of_type(edge_type).join(targets, "dst", "left_semi").select(F.col("src").alias("id"))


def callers(graph: PropertyGraph, node) -> DataFrame:
    """Distinct names of direct callers."""
    found = _into(graph, node, "CALLS").distinct()
    return (
        graph.nodes.select("id", "name")
        .join(found, "id", "left_semi")
        .where("name is not null")
        .select(F.col("name").alias("caller"))
        .distinct()
    )


def impact(graph: PropertyGraph, node, depth: int = 1) -> DataFrame:
    """Distinct ``(caller, is_volatile)`` of callers up to ``depth`` calls away."""
    seeds = resolve_ids(graph, node)
    found = reach_again(steps(graph, ("CALLS",), reverse=True), seeds, depth)
    return (
        graph.nodes.select("id", "name", "is_volatile")
        .join(found, "id", "left_semi")
        .where("name is not null")
        .select(F.col("name").alias("caller"), F.coalesce("is_volatile", F.lit(False)).alias("is_volatile"))
        .distinct()
    )


def globals_used(graph: PropertyGraph, node) -> DataFrame:
    """Name and file of each global a node uses directly."""
    users = resolve_ids(graph, node).select(F.col("id").alias("src"))
    used = graph.of_type("USES_GLOBAL").join(users, "src", "left_semi").select(F.col("dst").alias("id"))
    return graph.labelled("Global").select("id", "name", "file").join(used, "id").select("name", "file")


def coverage(graph: PropertyGraph, node) -> DataFrame:
    """Tests linked to a node."""
    tests = _into(graph, node, "TESTS")
    return (
        graph.labelled("Function", "Method").select("id", "label").join(tests, "id").select("id", "label")
    )


def hybrid_context(neighbor_rows: DataFrame, similar_rows: DataFrame) -> DataFrame:
    """Neighbours and similar functions in one frame, told apart by ``kind``."""
    return neighbor_rows.select(
        F.lit("neighbor").alias("kind"), "name", "type", F.lit(None).cast("double").alias("score")
    ).unionByName(
        similar_rows.select(
            F.lit("similar").alias("kind"), F.col("id").alias("name"), F.col("label").alias("type"), "score"
        )
    )


def summarize(parts: dict[str, DataFrame]) -> DataFrame:
    """Row counts instead of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("part"), "count")
        for name, df in parts.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
