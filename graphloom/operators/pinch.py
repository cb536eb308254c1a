"""Ranked reports: pinch points between stable and volatile code, and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import full_match
from graphloom.model import PropertyGraph

TOP_ROWS = 20


class MissingData(RuntimeError):
    """An enrichment that the report rests on has not been run."""


def _require(functions: DataFrame, column: str, message: str) -> None:
    if functions.where(F.col(column).isNotNull()).isEmpty():
        raise MissingData(message)


def seams(
    graph: PropertyGraph, module: str = ".*", layer: str = "", strict: bool = False, check: bool = True
) -> DataFrame:
    """Functions with stable callers and volatile callees, by the product of both counts.

    ``layer`` is accepted and unused. The module pattern decides which file is shown, not
    which function is listed; ``strict`` makes it a filter. One row per function and file.
    """
    functions = graph.labelled("Function").select("id", "name", "is_volatile")
    if check:
        _require(functions, "is_volatile", "volatility data is missing: seed volatility first")
    calls = graph.of_type("CALLS").select("src", "dst").distinct()
    steady = functions.where("not coalesce(is_volatile, false)").select(F.col("id").alias("src"))
    volatile = functions.where("is_volatile").select(F.col("id").alias("dst"))

    fan_out = (
        calls.join(volatile, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    )
    # Only functions with a volatile callee can score, so their callers alone are counted.
    fan_in = (
        calls.join(fan_out.select(F.col("id").alias("dst")), "dst", "left_semi")
        .join(steady, "src", "left_semi")
        .groupBy(F.col("dst").alias("id"))
        .agg(F.count("*").alias("fan_in"))
    )
    files = graph.labelled("File").select(F.col("id").alias("file_id"), "file")
    if module:
        files = files.where(full_match(F.col("file"), module))
    located = (
        graph.of_type("DEFINED_IN")
        .select(F.col("src").alias("id"), F.col("dst").alias("file_id"))
        .join(files, "file_id")
        .select("id", "file_id", "file")
        .distinct()
    )
    scored = functions.select("id", "name").join(fan_out, "id").join(fan_in, "id")
    return (
        scored.join(located, "id", "inner" if strict else "left")
        .select(
            "id",
            F.col("name").alias("seam"),
            F.coalesce("file", F.lit("")).alias("file"),
            (F.col("fan_in") * F.col("fan_out")).cast("double").alias("risk"),
            F.lit("pinch-point").alias("type"),
        )
        .orderBy(F.desc("risk"), "id", "file")
        .limit(TOP_ROWS)
        .select("seam", "file", "risk", "type")
    )


def hotspots(graph: PropertyGraph, module: str = ".*", check: bool = True) -> DataFrame:
    """Functions by risk times churn of their file."""
    functions = graph.labelled("Function").select("id", "name", "risk_score")
    if check:
        _require(functions, "risk_score", "risk score data is missing: calculate risk scores first")
    files = (
        graph.labelled("File")
        .where(full_match(F.col("file"), module))
        .select(F.col("id").alias("dst"), "file", F.coalesce("change_frequency", F.lit(0)).alias("churn"))
    )
    located = graph.of_type("DEFINED_IN").join(files, "dst").select(F.col("src").alias("id"), "file", "churn")
    return (
        functions.join(located, "id")
        .orderBy(
            F.desc(F.coalesce("risk_score", F.lit(0.0)) * F.col("churn")),
            F.desc_nulls_first("risk_score"),
            "id",
        )
        .limit(TOP_ROWS)
        .select("name", "file", F.col("risk_score").alias("risk"), "churn")
    )
