"""What would break if a set of nodes were taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.session import broadcast_if_small

# Lists up to this length become a literal filter; longer ones a join.
LITERAL_TARGETS = 200


def _tagged(frame: DataFrame, key: str, targets, out: str) -> DataFrame:
    """``frame`` with a boolean column: is ``key`` one of the targets."""
    if isinstance(targets, DataFrame):
        marks = targets.select(F.col("id").alias(key)).distinct().withColumn(out, F.lit(True))
        return frame.join(marks, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))
    return frame.withColumn(out, F.coalesce(F.col(key).isin(list(targets)), F.lit(False)))


def _targets(graph: PropertyGraph, targets):
    if isinstance(targets, DataFrame):
        return broadcast_if_small(targets.select("id").distinct())
    if len(targets) > LITERAL_TARGETS:
        return broadcast_if_small(
            graph.spark.createDataFrame([(t,) for t in targets], "id string").distinct()
        )
    return list(targets)


def what_if(graph: PropertyGraph, targets) -> dict[str, DataFrame]:
    """Five result sets for taking out ``targets`` (ids, or a DataFrame of ``id``)."""
    inside = _targets(graph, targets)
    edges = _tagged(_tagged(graph.edges, "src", inside, "src_in"), "dst", inside, "dst_in")
    labels = graph.nodes.select("id", "label")

    severed = edges.where("src_in <> dst_in").select(
        F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "type"
    )

    functions = graph.labelled("Function").select("id")
    calls = edges.where("type = 'CALLS'")
    crossing = (
        calls.where("not src_in and dst_in")
        .join(functions.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(functions.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "type")
    )

    # Two flags per global instead of pairing its users.
    shared_ids = (
        edges.where("type = 'USES_GLOBAL'")
        .join(functions.withColumnRenamed("id", "src"), "src", "left_semi")
        .groupBy(F.col("dst").alias("id"))
        .agg(F.bool_or("src_in").alias("used_inside"), F.bool_or(~F.col("src_in")).alias("used_outside"))
        .where("used_inside and used_outside")
        .select("id")
    )
    shared = labels.where("label = 'Global'").join(shared_ids, "id", "left_semi").select("id", "label")

    orphan_ids = (
        calls.groupBy(F.col("dst").alias("id"))
        .agg(F.bool_and("src_in").alias("all_inside"), F.bool_or("dst_in").alias("is_target"))
        .where("all_inside and not is_target")
        .select("id")
    )
    orphaned = (
        labels.where("label not in ('File', 'Global')").join(orphan_ids, "id", "left_semi").select("id", "label")
    )

    touched = severed.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    affected = labels.join(touched, "id", "left_semi").select("id", "label")
    return {
        "severed": severed,
        "cross_boundary": crossing,
        "shared_state": shared,
        "orphaned": orphaned,
        "affected": affected,
    }
