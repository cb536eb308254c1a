"""Pipeline steps from sources to a loaded graph, composed of extractors, merges and deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.api import build_all
from graphloom.model import PropertyGraph, conform_nodes
from graphloom.operators.incremental import affected_files, delete_affected
from graphloom.operators.structure import state_row, update_graph_state
from graphloom.operators.upsert import merge_nodes, resolve_edges, upsert_edges, upsert_nodes
from graphloom.session import broadcast_if_small, cut
from graphloom.sources.build import include_edges, project_graph
from graphloom.sources.clang_ast import extract_trees
from graphloom.sources.files import list_files, read_files
from graphloom.sources.graph_store import GraphStore
from graphloom.sources.languages import extract


def _numbered(nodes: DataFrame) -> DataFrame:
    """Rows of one extraction have no order among themselves: values of a node agree or are null."""
    return nodes.withColumn("seq", F.lit(0).cast("bigint"))


def loaded(*parts: PropertyGraph) -> PropertyGraph:
    """Parts merged by id, their edges resolved against all nodes."""
    nodes = reduce(DataFrame.unionByName, [conform_nodes(p.nodes) for p in parts])
    edges = reduce(DataFrame.unionByName, [p.edges.select("src", "dst", "type") for p in parts])
    merged = cut(merge_nodes(_numbered(nodes)))
    return PropertyGraph(merged, resolve_edges(merged, edges))


def ingest(spark: SparkSession, root: str, paths: DataFrame | None = None) -> PropertyGraph:
    """The graph of a source tree, or of the listed ``paths(path)`` of it."""
    return loaded(extract(read_files(list_files(spark, root) if paths is None else paths, root)))


def _clang_parts(dumps: DataFrame, root: str, include_logs: DataFrame | None) -> list[PropertyGraph]:
    parts = [extract_trees(dumps, root)]
    if include_logs is not None:
        edges = cut(include_edges(include_logs, root))
        # An included file is a node also where no dump declares anything in it.
        ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        files = ids.select("id", F.lit("File").alias("label"), F.expr("substring(id, 6)").alias("name"), F.expr("substring(id, 6)").alias("file"))
        parts.append(PropertyGraph(conform_nodes(files), edges))
    return parts


def clang_ingest(dumps: DataFrame, root: str, include_logs: DataFrame | None = None, parsed: DataFrame | None = None, solutions: DataFrame | None = None) -> PropertyGraph:
    """The graph of syntax dumps ``(path, text)``, with include edges and projects where given."""
    parts = _clang_parts(dumps, root, include_logs)
    if parsed is not None and solutions is not None:
        parts.append(project_graph(parsed, solutions, root))
    return loaded(*parts)


def clang_incremental(graph: PropertyGraph, dumps: DataFrame, changed_headers: DataFrame, changed_sources: DataFrame, root: str, commit: str, include_logs: DataFrame | None = None) -> PropertyGraph:
    """The graph after a change: what lies in affected files goes, what their new dumps hold comes in, the commit is stamped.

    ``dumps`` are those of the affected sources; changed files have a ``file`` column, relative to the root.
    """
    kept = delete_affected(graph, affected_files(graph, changed_headers, changed_sources)).settle()
    fresh = [p.settle() for p in _clang_parts(dumps, root, include_logs)]
    # Nodes of all parts come before edges: an edge needs both its ends.
    kept = upsert_nodes(kept, _numbered(reduce(DataFrame.unionByName, [conform_nodes(p.nodes) for p in fresh]))).settle()
    kept = upsert_edges(kept, reduce(DataFrame.unionByName, [p.edges.select("src", "dst", "type") for p in fresh])).settle()
    return update_graph_state(kept, commit)


def store_incremental(store: GraphStore, dumps: DataFrame, changed_headers: DataFrame, changed_sources: DataFrame, root: str, commit: str, include_logs: DataFrame | None = None) -> GraphStore:
    """``clang_incremental`` on a stored graph, as one change of it: only buckets that hold affected nodes or edges are written."""
    graph = store.graph()
    affected = affected_files(graph, changed_headers, changed_sources)
    gone = store.nodes.select("id", "file").join(broadcast_if_small(cut(affected)), "file", "left_semi").select("id")
    fresh = [p.settle() for p in _clang_parts(dumps, root, include_logs)]
    nodes = reduce(DataFrame.unionByName, [conform_nodes(p.nodes) for p in fresh]).unionByName(state_row(store.spark, commit))
    return store.apply(_numbered(nodes), reduce(DataFrame.unionByName, [p.edges.select("src", "dst", "type") for p in fresh]), gone)


def clang_build_all(dumps: DataFrame, root: str, sources: DataFrame, touches: DataFrame, extractor, embedder, summarizer, commit: str = "", **more) -> PropertyGraph:
    """Load the dumps, then the whole chain of enrichment."""
    return build_all(clang_ingest(dumps, root, **more).settle(), sources, touches, extractor, embedder, summarizer, commit)
