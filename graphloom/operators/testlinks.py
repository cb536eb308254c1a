"""Linking tests to the code they test by naming convention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph


def test_links(graph: PropertyGraph) -> DataFrame:
    """``(test_id, prod_id)`` where a test is named TestX, XTest or XTests."""
    functions = graph.labelled("Function", "Method").select("id", "name", "is_test")
    tests = functions.where("is_test").select(F.col("id").alias("test_id"), F.col("name").alias("wanted"))
    name = F.col("name")
    wanted = F.array(F.concat(F.lit("Test"), name), F.concat(name, F.lit("Test")), F.concat(name, F.lit("Tests")))
    prods = functions.where("not coalesce(is_test, false) and name is not null").select(
        F.col("id").alias("prod_id"), F.explode(wanted).alias("wanted")
    )
    return tests.join(prods, "wanted").select("test_id", "prod_id").distinct()


def link_tests(graph: PropertyGraph) -> PropertyGraph:
    """The graph with a TESTS edge for every link."""
    links = test_links(graph).select(
        F.col("test_id").alias("src"), F.col("prod_id").alias("dst"), F.lit("TESTS").alias("type")
    )
    return graph.with_edges(graph.edges.unionByName(links).distinct())
