"""Volatility seeding and propagation, and the risk score built on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import full_match
from graphloom.model import NODE_COLUMNS, PropertyGraph
from graphloom.operators.reach import distances, steps
from graphloom.session import cut

FAN_IN_WEIGHT = 0.4
FAN_OUT_WEIGHT = 0.1
VOLATILITY_WEIGHT = 3.0
CHURN_WEIGHT = 0.4
SCORE_HOPS = 2


@dataclass(frozen=True)
class VolatilityRule:
    """``kind`` is ``file`` or ``function``; ``heuristic`` is ``path`` or ``content``."""

    layer: str
    pattern: str
    kind: str
    heuristic: str = "path"


def seed_ids(graph: PropertyGraph, module: str, rules: Sequence[VolatilityRule]) -> DataFrame:
    """Ids of functions that any rule marks, in one pass over functions and their files."""
    hits = F.lit(False)
    for rule in rules:
        if rule.kind == "file":
            hit = full_match(F.col("file_path"), rule.pattern)
        elif rule.kind == "function" and rule.heuristic == "path":
            hit = full_match(F.col("name"), rule.pattern)
        elif rule.kind == "function" and rule.heuristic == "content":
            hit = full_match(F.col("content"), rule.pattern)
        else:
            continue
        hits = hits | F.coalesce(hit, F.lit(False))
    files = graph.labelled("File").select(F.col("id").alias("dst"), F.col("file").alias("file_path"))
    located = (
        graph.of_type("DEFINED_IN")
        .join(files.where(full_match(F.col("file_path"), module)), "dst")
        .select(F.col("src").alias("id"), "file_path")
    )
    functions = graph.labelled("Function").select("id", "name", "content")
    return functions.join(located, "id").where(hits).select("id").distinct()


def _set_column(graph: PropertyGraph, column: str, values: DataFrame, default=None) -> PropertyGraph:
    """Replace a column of functions from ``(id, value)``."""
    marked = values.select("id", F.col("value").alias("__value"))
    joined = graph.labelled("Function").join(marked, "id", "left")
    fresh = F.coalesce("__value", default) if default is not None else F.col("__value")
    return graph.with_part("Function", joined.withColumn(column, fresh).select(*NODE_COLUMNS))


def seed_volatility(graph: PropertyGraph, module: str, rules: Sequence[VolatilityRule]) -> PropertyGraph:
    """Clear the flags and scores of all functions, then flag what the rules mark."""
    unscored = graph.labelled("Function").withColumn("volatility_score", F.lit(None).cast("double"))
    seeds = seed_ids(graph, module, rules).withColumn("value", F.lit(True))
    return _set_column(graph.with_part("Function", unscored), "is_volatile", seeds)


def count_volatile(graph: PropertyGraph) -> DataFrame:
    return graph.labelled("Function").where("is_volatile").agg(F.count("*").alias("count"))


def _function_calls(graph: PropertyGraph) -> DataFrame:
    """Reverse call steps between functions."""
    functions = graph.labelled("Function").select("id")
    return (
        steps(graph, ("CALLS",), reverse=True)
        .join(functions.withColumnRenamed("id", "at"), "at", "left_semi")
        .join(functions.withColumnRenamed("id", "to"), "to", "left_semi")
    )


def volatile_hops(graph: PropertyGraph) -> DataFrame:
    """``(id, hops)`` of every function that reaches a volatile one through calls."""
    seeds = graph.labelled("Function").where("is_volatile").select("id")
    return distances(_function_calls(graph), seeds)


def propagate_volatility(graph: PropertyGraph) -> PropertyGraph:
    """Flag every direct and indirect caller of a volatile function."""
    found = volatile_hops(graph).select("id", F.lit(True).alias("value"))
    return _set_column(graph, "is_volatile", found, default=F.col("is_volatile"))


def volatility_scores(graph: PropertyGraph) -> DataFrame:
    """``1 / (1 + hops)`` to the nearest volatile function within two calls, else 0."""
    functions = graph.labelled("Function")
    seeds = functions.where("is_volatile").select("id")
    near = distances(steps(graph, ("CALLS",), reverse=True), seeds, SCORE_HOPS)
    score = F.when(F.col("hops").isNotNull(), 1.0 / (F.col("hops") + 1.0)).otherwise(0.0)
    return functions.select("id").join(near, "id", "left").select("id", score.alias("volatility_score"))


def risk_scores(graph: PropertyGraph) -> DataFrame:
    """Fan-in, fan-out, churn and the risk score scaled by its maximum."""
    calls = graph.of_type("CALLS").select("src", "dst").distinct()
    fan_in = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    fan_out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    files = graph.labelled("File").select(F.col("id").alias("dst"), "change_frequency")
    churn = (
        graph.of_type("DEFINED_IN")
        .join(files, "dst")
        .groupBy(F.col("src").alias("id"))
        .agg(F.max("change_frequency").alias("churn"))
    )
    zero = F.lit(0)
    raw = (
        volatility_scores(graph)
        .join(fan_in, "id", "left")
        .join(fan_out, "id", "left")
        .join(churn, "id", "left")
        .select(
            "id",
            "volatility_score",
            F.coalesce("fan_in", zero).alias("fan_in"),
            F.coalesce("fan_out", zero).alias("fan_out"),
            F.coalesce("churn", zero).alias("churn"),
        )
        .withColumn(
            "raw",
            F.col("fan_in") * FAN_IN_WEIGHT
            + F.col("fan_out") * FAN_OUT_WEIGHT
            + F.col("volatility_score") * VOLATILITY_WEIGHT
            + F.col("churn") * CHURN_WEIGHT,
        )
    )
    raw = cut(raw)
    scale = raw.agg(F.max("raw")).first()[0] or 1.0
    return raw.select(
        "id", "fan_in", "fan_out", "churn", "volatility_score", (F.col("raw") / F.lit(scale)).alias("risk_score")
    )


def with_risk(graph: PropertyGraph) -> PropertyGraph:
    """The graph with volatility and risk scores set on its functions."""
    scored = risk_scores(graph).select(
        "id", F.col("volatility_score").alias("__vol"), F.col("risk_score").alias("__risk")
    )
    joined = graph.labelled("Function").join(scored, "id", "left")
    return graph.with_part(
        "Function",
        joined.withColumn("volatility_score", F.coalesce("__vol", "volatility_score"))
        .withColumn("risk_score", F.coalesce("__risk", "risk_score"))
        .select(*NODE_COLUMNS),
    )
