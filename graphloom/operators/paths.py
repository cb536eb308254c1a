"""Path-valued operators: trails, hierarchy traces, dependency paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.lookup import resolve_ids, resolve_one
from graphloom.session import cut

# Trails longer than this are cut every hop, so that no plan replays earlier hops.
LAZY_DEPTH = 3


def _oriented(graph: PropertyGraph, types: tuple[str, ...], direction: str) -> DataFrame:
    """Moves ``at -> to`` carrying the key of the edge they use."""
    edges = graph.of_type(*types).distinct()
    key = F.struct("src", "dst", "type").alias("edge")
    forward = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), key)
    backward = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), key)
    if direction == "outgoing":
        return forward
    if direction == "incoming":
        return backward
    if direction == "both":
        return forward.unionByName(backward.where("at <> to"))
    raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")


def trails(
    graph: PropertyGraph,
    starts: DataFrame,
    types: tuple[str, ...] = (),
    direction: str = "outgoing",
    depth: int = 1,
    least: int = 1,
) -> DataFrame:
    """``(node_ids, edges, end_id)`` of every trail of ``least..depth`` edges.

    A trail uses no edge twice; nodes may repeat.
    """
    moves = _oriented(graph, types, direction)
    if depth > LAZY_DEPTH:
        moves = cut(moves)
    no_edges = F.array().cast("array<struct<src:string,dst:string,type:string>>")
    level = starts.select(
        F.array("id").alias("node_ids"), no_edges.alias("edges"), F.col("id").alias("end_id")
    )
    kept = [level] if least == 0 else []
    for hop in range(1, depth + 1):
        fresh = ~F.array_contains(F.col("edges"), F.col("edge"))
        joined = level.join(moves, F.col("end_id") == F.col("at"))
        if hop > 1:
            joined = joined.where(fresh)
        level = joined.select(
            F.concat("node_ids", F.array("to")).alias("node_ids"),
            F.concat("edges", F.array("edge")).alias("edges"),
            F.col("to").alias("end_id"),
        )
        if depth > LAZY_DEPTH:
            level = cut(level)
        if hop >= least:
            kept.append(level)
    if not kept:
        return level.limit(0)
    return reduce(DataFrame.unionByName, kept)


def traverse(
    graph: PropertyGraph,
    start,
    types: str = "",
    direction: str = "outgoing",
    depth: int = 1,
) -> DataFrame:
    """All trails of 1..``depth`` edges from the nodes ``start`` names.

    ``types`` is a comma-separated list, empty for any type.
    """
    wanted = tuple(t.strip() for t in types.split(",") if t.strip())
    found = trails(graph, resolve_ids(graph, start), wanted, direction, max(depth, 0))
    return found.select(
        F.size("edges").cast("bigint").alias("path_len"),
        F.array_join("node_ids", ">").alias("node_path"),
        F.array_join(F.transform("edges", lambda e: e["type"]), ">").alias("edge_path"),
        F.col("end_id"),
    )


def path_rows(graph: PropertyGraph, found: DataFrame) -> DataFrame:
    """Hydrate trails to node structs, one array per trail, embeddings left out."""
    keyed = found.withColumn("path_id", F.sha2(F.to_json(F.struct("node_ids", "edges")), 256))
    public = graph.public_nodes()
    steps = keyed.select("path_id", F.posexplode("node_ids").alias("pos", "id"))
    nodes = (
        steps.join(public, "id")
        .select("path_id", F.struct("pos", *public.columns).alias("node"))
        .groupBy("path_id")
        .agg(F.array_sort(F.collect_list("node"), lambda x, y: x["pos"] - y["pos"]).alias("nodes"))
    )
    return keyed.join(nodes, "path_id").select("nodes", "edges")


def semantic_trace(graph: PropertyGraph, node) -> DataFrame:
    """Domain, feature, function and file on the hierarchy path of a function.

    The implementing edge is accepted in both orientations: pipelines write it from the
    function, hand-made graphs from the feature.
    """
    named = resolve_ids(graph.with_nodes(graph.labelled("Function")), node)
    functions = named.select(F.col("id").alias("function_id"))
    features = graph.labelled("Feature").select(F.col("id").alias("feature_id"))
    domains = graph.labelled("Domain").select(F.col("id").alias("domain_id"))
    files = graph.labelled("File").select(F.col("id").alias("file_id"))
    implements = graph.of_type("IMPLEMENTS")
    either = implements.select(
        F.col("src").alias("function_id"), F.col("dst").alias("feature_id")
    ).unionByName(
        implements.select(F.col("dst").alias("function_id"), F.col("src").alias("feature_id"))
    )
    parents = graph.of_type("PARENT_OF").select(
        F.col("src").alias("domain_id"), F.col("dst").alias("feature_id")
    )
    located = graph.of_type("DEFINED_IN").select(
        F.col("src").alias("function_id"), F.col("dst").alias("file_id")
    )
    return (
        functions.join(either, "function_id")
        .join(features, "feature_id", "left_semi")
        .join(parents, "feature_id")
        .join(domains, "domain_id", "left_semi")
        .join(located, "function_id")
        .join(files, "file_id", "left_semi")
        .select("domain_id", "feature_id", "function_id", "file_id")
    )


def neighbors(graph: PropertyGraph, node, depth: int = 1, limit: int = 10) -> DataFrame:
    """Globals a node reaches through calls, then its direct calls and uses.

    The scope is the node and, for a class, its methods. Globals come with the names of
    the path that leads to them. The cut to ``limit`` keeps globals first.
    """
    root = resolve_one(graph, node)
    methods = (
        graph.of_type("HAS_METHOD")
        .join(root.select(F.col("id").alias("src")), "src", "left_semi")
        .select(F.col("dst").alias("id"))
    )
    scope = root.unionByName(methods).distinct()
    names = graph.nodes.select("id", "name", "label")

    calls = trails(graph, scope, ("CALLS",), "outgoing", depth, least=0)
    uses = graph.of_type("USES_GLOBAL").select(F.col("src").alias("end_id"), F.col("dst").alias("gid"))
    global_names = graph.labelled("Global").select(F.col("id").alias("gid"), F.col("name").alias("gname"))
    hits = calls.join(uses, "end_id").join(global_names, "gid")
    ids = F.concat("node_ids", F.array("gid"))
    # Paths are told apart by what they hold: a number would change with every retry of a task.
    paths = hits.select(F.to_json(ids).alias("row"), ids.alias("ids"), F.col("gname").alias("name")).dropDuplicates(["row", "name"])
    if depth > 0:
        named = (
            paths.select("row", "name", F.col("ids")[0].alias("start"), F.posexplode("ids").alias("pos", "id"))
            .where("id <> start")
            .join(names.select("id", F.col("name").alias("step")), "id", "left")
            .groupBy("row", "name")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("steps"))
            .select("name", F.transform("steps", lambda s: s["step"]).alias("via"))
        )
    else:
        named = paths.select("name", F.array("name").alias("via"))
    globals_found = named.select(
        F.lit(0).alias("rank"), "name", F.lit("Global").alias("type"), F.array_join("via", ">").alias("via")
    ).distinct()

    direct = (
        graph.of_type("CALLS", "USES")
        .join(scope.select(F.col("id").alias("src")), "src", "left_semi")
        .select(F.col("dst").alias("id"))
        .distinct()
        .join(names, "id")
        .select(F.lit(1).alias("rank"), "name", F.col("label").alias("type"), F.lit("").alias("via"))
        .distinct()
    )
    return (
        globals_found.unionByName(direct)
        .orderBy("rank", "name", "via", "type")
        .limit(limit)
        .select("name", "type", "via")
    )
