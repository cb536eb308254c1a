"""Line-delimited JSON graphs: reading, classification, writing.

A record with a ``source`` is an edge, any other a node whose ``type`` is its label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import NODE_SCHEMA, SUPER_LABEL, PropertyGraph, sanitize_label
from graphloom.operators.upsert import merge_nodes, resolve_edges
from graphloom.session import cut, exchanges, short_splits

_OWN = {"id", "label", "labels", "extra"}
DEFAULT_LABEL = "Generic"


def located(lines: DataFrame, *first: Column) -> DataFrame:
    """``(value, place)`` of text lines read with their ``_metadata``: ``first``, the file, and the split of it."""
    return lines.select("value", F.struct(*first, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")).alias("place"))


def in_file_order(lines: DataFrame) -> DataFrame:
    """``(value, seq)`` of located lines.

    Splits of files are packed into tasks by size, so a task's numbering says nothing about
    other splits: it orders the lines of one, and the place comes before it.
    """
    return lines.select("value", F.struct("place", F.monotonically_increasing_id().alias("at")).alias("seq"))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """``(value, seq)`` in the order of paths, files and lines; ``path`` is one path or a list."""
    paths = [path] if isinstance(path, str) else list(path)
    return reduce(DataFrame.unionByName, [in_file_order(located(spark.read.text(p), F.lit(i).alias("path"))) for i, p in enumerate(paths)])


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(seq, record)`` with the record as a map, null for lines that do not parse.

    Values keep their JSON text, so numbers are not bent through one type. Unparsed lines
    are neither nodes nor edges and fall out there; a filter here would repeat the parse.
    """
    record = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    return lines.select("seq", record.alias("record"))


def number(text: Column) -> Column:
    """``(as_long, as_double)`` of JSON number text: whole numbers first."""
    whole = F.when(text.rlike("\\A-?[0-9]+\\z"), text.try_cast("bigint"))
    return F.struct(whole.alias("as_long"), text.try_cast("double").alias("as_double"))


def node_records(records: DataFrame) -> DataFrame:
    """Node rows with ``seq``, and in ``cleared`` what they set to null; rows without an id are dropped."""
    rec = F.col("record")
    nodes = records.where(~F.map_contains_key(rec, F.lit("source"))).where("coalesce(record['id'], '') <> ''")
    label = F.coalesce(F.nullif(sanitize_label(rec["type"]), F.lit("")), F.lit(DEFAULT_LABEL))
    cols = [rec["id"].alias("id"), label.alias("label"), F.array(label, F.lit(SUPER_LABEL)).alias("labels")]
    known = {"id", "type"}
    for field in NODE_SCHEMA:
        if field.name in _OWN:
            continue
        known.add(field.name)
        kind = field.dataType.simpleString()
        value = F.from_json(rec[field.name], kind) if kind.startswith("array") else rec[field.name].try_cast(kind)
        cols.append(value.alias(field.name))
    rest = F.map_filter(rec, lambda k, v: ~k.isin(sorted(known)) & v.isNotNull())
    cleared = F.map_keys(F.map_filter(rec, lambda _, v: v.isNull()))
    return nodes.select("seq", *cols, F.when(F.size(rest) > 0, rest).alias("extra"), F.when(F.size(cleared) > 0, cleared).alias("cleared"))


def edge_records(records: DataFrame) -> DataFrame:
    """Edge rows; rows without both ends are dropped."""
    rec = F.col("record")
    return records.where(F.map_contains_key(rec, F.lit("source"))).select(
        rec["source"].alias("src"), rec["target"].alias("dst"), F.coalesce(rec["type"], F.lit("")).alias("type")
    ).where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''")


def load_graph(lines: DataFrame) -> PropertyGraph:
    """A graph from ``(value, seq)`` lines: nodes merged by id, edges resolved."""
    # Parsed once: the optimizer would otherwise repeat the parse in every filter it pushes.
    with short_splits(lines.sparkSession):
        records = cut(parse_lines(lines))
    # Nodes are read three times while edges are resolved; they are merged once, in as many tasks as read them.
    with exchanges(lines.sparkSession, max(lines.sparkSession.sparkContext.defaultParallelism, records.rdd.getNumPartitions())):
        nodes = cut(merge_nodes(node_records(records)))
    return PropertyGraph(nodes, resolve_edges(nodes, edge_records(records)))


def read_graph(spark: SparkSession, path) -> PropertyGraph:
    return load_graph(read_lines(spark, path))


def node_lines(nodes: DataFrame) -> DataFrame:
    """One JSON text per node, open properties at the top level."""
    typed = F.to_json(F.struct("id", F.col("label").alias("type"), *[f.name for f in NODE_SCHEMA if f.name not in _OWN]))
    extra = F.to_json("extra")
    both = F.concat(F.expr("substring(typed, 1, length(typed) - 1)"), F.lit(","), F.expr("substring(open, 2)"))
    rows = nodes.select(typed.alias("typed"), extra.alias("open"))
    return rows.select(F.when(F.col("open").isNull() | (F.col("open") == "{}"), F.col("typed")).otherwise(both).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("value"))


def write_combined(graph: PropertyGraph, path: str) -> None:
    node_lines(graph.nodes).unionByName(edge_lines(graph.edges)).write.mode("overwrite").text(path)


def write_split(graph: PropertyGraph, nodes_path: str, edges_path: str) -> None:
    node_lines(graph.nodes).write.mode("overwrite").text(nodes_path)
    edge_lines(graph.edges).write.mode("overwrite").text(edges_path)
