"""Hierarchy and whole-graph views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, conform_nodes
from graphloom.operators.reach import distances, steps
from graphloom.session import cut


def overview(graph: PropertyGraph) -> DataFrame:
    """All domains, and the features nothing points to."""
    # One row per target before the anti join: a feature may be the end of most edges.
    pointed_at = graph.edges.select(F.col("dst").alias("id")).distinct()
    domains = graph.labelled("Domain").select("id", "label")
    loose = graph.labelled("Feature").select("id", "label").join(pointed_at, "id", "left_anti")
    return domains.unionByName(loose)


def explore_domain(graph: PropertyGraph, feature_id: str) -> dict[str, DataFrame]:
    """The parent, children, siblings and implementing functions of a feature."""
    hierarchy = graph.labelled("Feature", "Domain")
    members = hierarchy.select("id")
    parent_of = graph.of_type("PARENT_OF").select(F.col("src").alias("up"), F.col("dst").alias("down"))
    self_row = hierarchy.where(F.col("id") == feature_id)

    parent_ids = parent_of.where(F.col("down") == feature_id).select(F.col("up").alias("id"))
    parent = members.join(parent_ids, "id", "left_semi").orderBy("id").limit(1)
    child_ids = parent_of.where(F.col("up") == feature_id).select(F.col("down").alias("id"))
    children = members.join(child_ids, "id", "left_semi")
    sibling_ids = (
        parent_of.join(parent.select(F.col("id").alias("up")), "up", "left_semi")
        .where(F.col("down") != feature_id)
        .select(F.col("down").alias("id"))
    )
    siblings = members.join(sibling_ids, "id", "left_semi")

    below = distances(steps(graph, ("PARENT_OF",)), self_row.select("id"))
    implementing = (
        graph.of_type("IMPLEMENTS")
        .join(below.select(F.col("id").alias("dst")), "dst", "left_semi")
        .select(F.col("src").alias("id"))
    )
    functions = graph.labelled("Function").select("id").join(implementing, "id", "left_semi")

    def shown(df: DataFrame, label: str) -> DataFrame:
        return df.select("id", F.lit(label).alias("label")).distinct()

    return {
        "feature": shown(self_row.select("id"), "Feature"),
        "parent": shown(parent, "Feature"),
        "children": shown(children, "Feature"),
        "siblings": shown(siblings, "Feature"),
        "functions": shown(functions, "Function"),
    }


def functions_under(graph: PropertyGraph) -> DataFrame:
    """``(feature_id, function_id)`` for every feature at once, descendants included."""
    parent_of = graph.of_type("PARENT_OF").select(F.col("src").alias("up"), F.col("dst").alias("down"))
    direct = (
        graph.of_type("IMPLEMENTS")
        .join(graph.labelled("Function").select(F.col("id").alias("src")), "src", "left_semi")
        .select(F.col("dst").alias("feature_id"), F.col("src").alias("function_id"))
        .distinct()
    )
    levels, level = [direct], direct
    while True:
        level = (
            level.join(parent_of, F.col("feature_id") == F.col("down"))
            .select(F.col("up").alias("feature_id"), "function_id")
            .distinct()
        )
        seen = reduce(DataFrame.unionByName, levels)
        level = cut(level.join(seen, ["feature_id", "function_id"], "left_anti"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).distinct()
        levels.append(level)


def graph_stats(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.agg(F.count(F.lit(1)).alias("nodes"))


def graph_state(graph: PropertyGraph) -> DataFrame:
    """The stored commit; one empty string when there is none."""
    stored = graph.labelled("GraphState").select(F.element_at("extra", "commit").alias("commit"))
    return stored.agg(F.coalesce(F.max("commit"), F.lit("")).alias("commit"))


def state_row(spark: SparkSession, commit: str) -> DataFrame:
    """The single state node."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = spark.range(1).select(
        F.lit("graph-state").alias("id"), F.lit("GraphState").alias("label"),
        F.create_map(F.lit("commit"), F.lit(commit), F.lit("updatedAt"), stamp).alias("extra"),
    )
    return conform_nodes(row)


def update_graph_state(graph: PropertyGraph, commit: str) -> PropertyGraph:
    """Replace the single state node."""
    return graph.with_nodes(graph.nodes.where("label <> 'GraphState' or label is null").unionByName(state_row(graph.spark, commit)))
