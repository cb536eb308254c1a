"""Clearing and writing the domain and feature layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.upsert import add_edges_by_id, upsert_nodes

LAYER = ("Feature", "Domain")


def detach_delete(graph: PropertyGraph, doomed: DataFrame) -> PropertyGraph:
    """Drop the nodes listed by ``id`` and every edge at them."""
    gone = doomed.select("id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return PropertyGraph(graph.nodes.join(gone, "id", "left_anti"), edges.select("src", "dst", "type"))


def clear_topology(graph: PropertyGraph) -> PropertyGraph:
    return detach_delete(graph, graph.labelled(*LAYER))


def update_topology(graph: PropertyGraph, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """Upsert layer nodes and edges; edges with an unknown end are dropped."""
    incoming = nodes if "seq" in nodes.columns else nodes.withColumn("seq", F.lit(0).cast("bigint"))
    return add_edges_by_id(upsert_nodes(graph, incoming), edges)
