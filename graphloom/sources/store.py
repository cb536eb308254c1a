"""Graph storage as Parquet, nodes by label and edges by type.

A query that names a label or type reads only its folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.model import NODE_COLUMNS, PropertyGraph


def write_graph(graph: PropertyGraph, path: str) -> None:
    graph.nodes.withColumn("part_label", F.col("label")).write.mode("overwrite").partitionBy("part_label").parquet(f"{path}/nodes")
    graph.edges.select("src", "dst", "type").write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    nodes = spark.read.parquet(f"{path}/nodes")
    columns = [F.col("part_label").alias("label") if c == "label" else F.col(c) for c in NODE_COLUMNS]
    return PropertyGraph(nodes.select(*columns), spark.read.parquet(f"{path}/edges").select("src", "dst", "type"))
