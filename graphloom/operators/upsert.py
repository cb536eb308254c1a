"""Loading: keyed node merges and edge merges with target resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import NODE_SCHEMA, SUPER_LABEL, PropertyGraph, conform_edges, sanitize_label
from graphloom.session import BROADCAST_ROWS, broadcast_if_small, cut, exchanges, shares

# Edges that one task compares or joins.
EDGES = 500_000


def merge_nodes(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row per id from a node frame with an ordering column.

    Each property keeps its last value, labels add up, ``extra`` maps are merged
    key by key. A null is no value, unless the row lists the property in ``cleared``: then it takes the value away. The last-value aggregates combine on the map side, so an id with very
    many versions shuffles one row per input partition.
    """
    versioned = rows.where("id is not null and id <> ''")
    if "cleared" not in rows.columns:
        versioned = versioned.withColumn("cleared", F.lit(None).cast("array<string>"))
    aggs = []
    for field in NODE_SCHEMA:
        col = field.name
        if col == "id":
            continue
        if col in ("labels", "extra"):
            continue
        known = F.col(col).isNotNull() | F.coalesce(F.array_contains("cleared", col), F.lit(False))
        aggs.append(F.max_by(F.when(known, F.col(col)), F.when(known, F.col(order))).alias(col))
    base = versioned.groupBy("id").agg(*aggs, F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))

    # Keys of the open property map are merged on their own: last value per (id, key).
    own = [f.name for f in NODE_SCHEMA]
    gone = F.filter(F.coalesce("cleared", F.array().cast("array<string>")), lambda k: ~k.isin(own))
    given = F.coalesce(F.map_entries("extra"), F.array().cast("array<struct<key:string,value:string>>"))
    listed = F.concat(F.filter(given, lambda e: e["value"].isNotNull()), F.transform(gone, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value"))))
    entries = (
        versioned.select("id", order, F.explode(listed).alias("e"))
        .groupBy("id", F.col("e.key").alias("key"))
        .agg(F.max_by("e.value", order).alias("value"))
        .where("value is not null")
    )
    maps = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("extra"))
    return base.join(maps, "id", "left").select(*[f.name for f in NODE_SCHEMA])


def upsert_nodes(graph: PropertyGraph, incoming: DataFrame) -> PropertyGraph:
    """Merge new rows over the stored ones. ``incoming`` has ``seq``, later wins."""
    kind = incoming.schema["seq"].dataType
    incoming = cut(incoming)
    keys = broadcast_if_small(incoming.select("id").distinct())
    # Stored rows that no key touches pass through; where keys are few they are not shuffled.
    if "cleared" not in incoming.columns:
        incoming = incoming.withColumn("cleared", F.lit(None).cast("array<string>"))
    stored = graph.nodes.withColumn("cleared", F.lit(None).cast("array<string>")).join(keys, "id", "left_semi").withColumn("seq", F.struct(F.lit(0).alias("new"), F.lit(None).cast(kind).alias("seq")))
    fresh = incoming.withColumn("seq", F.struct(F.lit(1).alias("new"), "seq"))
    merged = merge_nodes(stored.unionByName(fresh.select(*stored.columns)))
    return graph.with_nodes(graph.nodes.join(keys, "id", "left_anti").select(*merged.columns).unionByName(merged))


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends known.

    Sources match an id; targets match an id or a qualified name, which may fan out to
    overloads. Two equi-joins are united instead of one join on a disjunction.
    """
    edges = edges.withColumn("type", F.coalesce(F.nullif(sanitize_label(F.col("type")), F.lit("")), F.lit("RELATED_TO")))
    # Written out as they come, so that they are counted before anything is dealt out.
    edges = cut(edges.where("src <> '' and dst <> ''").select("src", "dst", "type"))
    ids, names = nodes.select("id"), nodes.where("fqn is not null").select("fqn", "id")
    with exchanges(edges.sparkSession, shares(edges, EDGES)):
        edges = cut(edges.distinct())
        ends = _ends(edges)
        if ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            # Few ends: nodes are filtered where they lie, and only those that are ends are shuffled.
            ids = ids.join(F.broadcast(ends), "id", "left_semi")
            names = names.join(F.broadcast(ends.withColumnRenamed("id", "fqn")), "fqn", "left_semi")
        anchored = cut(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
        by_id = anchored.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")
        named = names.select(F.col("fqn").alias("dst"), F.col("id").alias("target"))
        by_fqn = anchored.join(named, "dst").select("src", F.col("target").alias("dst"), "type")
        return cut(by_id.unionByName(by_fqn).distinct())


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def add_edges(graph: PropertyGraph, fresh: DataFrame) -> PropertyGraph:
    """Add edges that are not stored yet; stored ones are looked at where they lie."""
    columns = ["src", "dst", "type"]
    fresh = cut(conform_edges(fresh).distinct())
    known = graph.edges.join(broadcast_if_small(fresh.select(*columns)), columns, "left_semi").select(*columns).distinct()
    return graph.with_edges(graph.edges.unionByName(conform_edges(fresh.join(known, columns, "left_anti"))))


def add_edges_by_id(graph: PropertyGraph, edges: DataFrame) -> PropertyGraph:
    """Add edges whose ends are both ids of nodes; others are dropped."""
    edges = cut(conform_edges(edges).distinct())
    ids = cut(graph.nodes.select("id").join(broadcast_if_small(cut(_ends(edges))), "id", "left_semi"))
    ids = broadcast_if_small(ids)
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return add_edges(graph, both.select("src", "dst", "type"))


def upsert_edges(graph: PropertyGraph, incoming: DataFrame) -> PropertyGraph:
    """Resolve edges and add those that are not stored yet."""
    return add_edges(graph, resolve_edges(graph.nodes, conform_edges(incoming)))


def set_properties(graph: PropertyGraph, updates: DataFrame, labels: tuple[str, ...] = ()) -> PropertyGraph:
    """Overwrite columns by id. ``updates`` has ``id`` and the columns to set."""
    columns = [c for c in updates.columns if c != "id"]
    renamed = updates.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = graph.nodes.join(broadcast_if_small(cut(renamed)), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    if labels:
        hit = hit & F.col("label").isin(*labels)
    out = [
        F.when(hit, F.col(f"__{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        if f.name in columns
        else F.col(f.name)
        for f in NODE_SCHEMA
    ]
    return graph.with_nodes(joined.select(*out))


def canonical_label(labels):
    """First label other than the one every loaded node carries."""
    own = F.filter(labels, lambda x: x != SUPER_LABEL)
    return F.coalesce(F.get(own, F.lit(0)), F.lit("Generic"))
