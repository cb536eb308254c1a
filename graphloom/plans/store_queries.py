"""Queries over state that is kept: a stored graph that changes, enrichment that is resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.api import extract_features
from graphloom.model import PropertyGraph, conform_edges, conform_nodes
from graphloom.operators.resumable import Stop, Stopped
from graphloom.plans.catalog import query
from graphloom.plans.retail import Tables, function_rows, text
from graphloom.session import ensure_checkpoint_dir
from graphloom.sources.graph_store import GraphStore


@query(
    "store_delta",
    """WITH p AS (SELECT p_partkey AS k, p_size AS z, p_brand AS brand, p_name || ' ' || (p_partkey // 100) AS name FROM part)
    SELECT 'node' AS kind, 'fn:' || k AS a, CASE WHEN z = 3 THEN 'renamed ' || k ELSE name END AS b FROM p WHERE z <> 7
    UNION ALL SELECT 'node', 'new:' || k, 'new ' || k FROM p WHERE z = 4
    UNION ALL SELECT DISTINCT 'node', 'file:' || brand, brand FROM p
    UNION ALL SELECT 'DEFINED_IN', 'fn:' || k, 'file:' || brand FROM p WHERE z <> 7
    UNION ALL SELECT 'CALLS', 'fn:' || a.k, 'fn:' || b.k FROM p a JOIN p b ON b.k = a.k + 1 WHERE a.z <> 7 AND b.z <> 7
    UNION ALL SELECT 'CALLS', 'fn:' || a.k, 'new:' || b.k FROM p a JOIN p b ON b.k = a.k + 1 WHERE a.z <> 7 AND b.z = 4
    UNION ALL SELECT 'before', (SELECT count(*) FROM p)::VARCHAR, (SELECT count(DISTINCT brand) FROM p)::VARCHAR""",
)
def store_delta(t: Tables) -> DataFrame:
    """A graph of parts is stored; parts of one size are renamed, those of another get a namesake, those of a third go. What is stored then, and what a reader of the first state still sees."""
    k, z = F.col("p_partkey"), F.col("p_size")
    numbered = lambda df: conform_nodes(df).withColumn("seq", F.lit(0))
    files = t.part.select(F.concat(F.lit("file:"), "p_brand").alias("id"), F.lit("File").alias("label"), F.col("p_brand").alias("name")).distinct()
    homes = t.part.select(text("fn:", "p_partkey").alias("src"), F.concat(F.lit("file:"), "p_brand").alias("dst"), F.lit("DEFINED_IN").alias("type"))
    calls = t.part.select(text("fn:", "p_partkey").alias("src"), F.concat(F.lit("part."), (k + 1).cast("string")).alias("dst"), F.lit("CALLS").alias("type"))
    store = GraphStore(t.spark, f"{ensure_checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}", buckets=16)
    first = store.apply(numbered(conform_nodes(function_rows(t)).unionByName(conform_nodes(files))), homes.unionByName(calls))
    renamed = t.part.where(z == 3).select(text("fn:", "p_partkey").alias("id"), F.lit("Function").alias("label"), text("renamed ", "p_partkey").alias("name"))
    added = t.part.where(z == 4).select(text("new:", "p_partkey").alias("id"), F.lit("Function").alias("label"), text("new ", "p_partkey").alias("name"), text("part.", "p_partkey").alias("fqn"))
    last = first.apply(numbered(conform_nodes(renamed).unionByName(conform_nodes(added))), gone=t.part.where(z == 7).select(text("fn:", "p_partkey").alias("id")))
    g = last.graph()
    by = lambda label: F.count_if(F.col("label") == label).cast("string")
    before = GraphStore(t.spark, store.path, generation=first.generation).nodes.agg(by("Function").alias("a"), by("File").alias("b"))
    out = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"))
    return out.unionByName(g.edges.select(F.col("type").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))).unionByName(before.select(F.lit("before").alias("kind"), "a", "b"))


def _described(code: str, name: str) -> tuple[list[str], bool]:
    if "blue" in name:
        raise ValueError("no answer")
    return [f"n{len(code.splitlines())}", name.split()[0]], name.startswith("a")


@query(
    "extraction_loop",
    """WITH p AS (SELECT 'fn:' || p_partkey AS id, *, p_size % 7 <> 0 AND p_size % 5 = 0 AND p_size % 11 <> 0 AS todo,
      CASE WHEN p_size >= 48 THEN true WHEN p_size >= 10 THEN false END AS volatile_before FROM part)
    SELECT id, CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size % 5 <> 0 THEN lower(p_type) || ',' || lower(p_name)
        WHEN NOT todo THEN NULL WHEN p_brand = 'Brand#11' THEN 'unreadable_source' WHEN p_name LIKE '%blue%' THEN NULL ELSE 'n11,' || split_part(p_name, ' ', 1) END AS features,
      CASE WHEN NOT todo OR (p_brand <> 'Brand#11' AND p_name LIKE '%blue%') THEN volatile_before WHEN p_brand = 'Brand#11' THEN false ELSE p_name LIKE 'a%' END AS is_volatile
    FROM p""",
)
def extraction_loop(t: Tables) -> DataFrame:
    """Descriptors of all parts without any by a callable that fails for some names; the first run is stopped by it, the second goes on."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    sources = t.part.where("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("file")).distinct().withColumn("text", lines)
    log = f"{ensure_checkpoint_dir(t.spark)}/answers-{uuid.uuid4().hex}"
    graph = PropertyGraph(conform_nodes(function_rows(t)), conform_edges(t.spark.createDataFrame([], "src string, dst string, type string")))

    def stopping(code: str, name: str) -> tuple[list[str], bool]:
        if name.startswith("p"):
            raise Stop("quota")
        return _described(code, name)

    how = {"log": log, "batch_rows": 20_000, "attempts": 2, "pause": 0.0}
    try:
        extract_features(graph, sources, stopping, **how)
    except Stopped:
        pass
    done = extract_features(graph, sources, _described, **how)
    return done.nodes.select("id", F.array_join("atomic_features", ",").alias("features"), "is_volatile")
