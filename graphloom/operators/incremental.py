"""Incremental update: what a change touches, and taking it out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.reach import distances, steps
from graphloom.operators.topology import detach_delete


def affected_files(graph: PropertyGraph, changed_headers: DataFrame, changed_sources: DataFrame) -> DataFrame:
    """Changed files and all that include a changed header, directly or not.

    Both inputs have a ``file`` column.
    """
    files = graph.labelled("File").select("id", "file")
    headers = files.join(changed_headers.select("file").distinct(), "file", "left_semi").select("id")
    includers = distances(steps(graph, ("INCLUDES",), reverse=True), headers)
    hit = files.join(includers, "id", "left_semi").select("file")
    return hit.unionByName(changed_headers.select("file")).unionByName(changed_sources.select("file")).distinct()


def delete_affected(graph: PropertyGraph, affected: DataFrame) -> PropertyGraph:
    """Drop every node that lies in an affected file, with its edges."""
    doomed = graph.nodes.select("id", "file").join(affected.select("file").distinct(), "file", "left_semi")
    return detach_delete(graph, doomed)


def remaining_counts(graph: PropertyGraph) -> DataFrame:
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("count")).select(F.lit("nodes").alias("part"), "count")
    edges = graph.edges.agg(F.count(F.lit(1)).alias("count")).select(F.lit("edges").alias("part"), "count")
    return nodes.unionByName(edges)
