"""Two-level semantic topology: domains of features of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import common_ancestor, domain_names, dominant_terms
from graphloom.functions.vectors import as_double, cosine_distance
from graphloom.model import PropertyGraph, conform_nodes
from graphloom.operators.backlog import embeddings_only, function_metadata
from graphloom.operators.kmeans import cluster_groups, domain_count, kmeans, ranked
from graphloom.operators.topology import clear_topology, update_topology
from graphloom.session import broadcast_if_small, cut

CENTRAL = 2
OUTER = 3
NO_VECTOR_DISTANCE = 2.0
DOMAIN_SNIPPET = 1000
FEATURE_SNIPPET = 3000
FEATURE_SNIPPETS = 11


def centroids(members: DataFrame) -> DataFrame:
    """``(cluster, centroid)``: mean of the vectors of ``members(cluster, id, vec)``.

    Partial sums per cluster and dimension combine before the shuffle.
    """
    sums = (
        members.where("vec is not null")
        .select("cluster", F.posexplode(as_double(F.col("vec"))).alias("dim", "x"))
        .groupBy("cluster", "dim")
        .agg(F.avg("x").alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return sums.groupBy("cluster").agg(F.transform(ordered, lambda d: d["x"]).alias("centroid"))


def representatives(members: DataFrame) -> DataFrame:
    """Up to five members per cluster: all, or the two nearest and three farthest.

    Two ranked windows with a rank filter; Spark keeps only the first rows of each group
    before it shuffles, so a very large cluster is not gathered.
    """
    means = centroids(members)
    distance = F.when(F.col("vec").isNull(), F.lit(NO_VECTOR_DISTANCE)).otherwise(
        cosine_distance(F.col("vec"), F.col("centroid"))
    )
    scored = members.join(means, "cluster").select("cluster", "id", F.round(distance, 9).alias("distance"))
    limit = CENTRAL + OUTER
    near = W.partitionBy("cluster").orderBy("distance", "id")
    far = W.partitionBy("cluster").orderBy(F.desc("distance"), F.desc("id"))
    first = scored.withColumn("n", F.row_number().over(near)).where(F.col("n") <= limit)
    last = scored.withColumn("m", F.row_number().over(far)).where(F.col("m") <= OUTER)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    kept_near = first.join(sizes, "cluster").where((F.col("size") <= limit) | (F.col("n") <= CENTRAL))
    kept_far = last.join(sizes, "cluster").where(F.col("size") > limit)
    return kept_near.select("cluster", "id", "distance").unionByName(kept_far.select("cluster", "id", "distance"))


def unique_names(named: DataFrame, name: str = "name", order: str = "cluster") -> DataFrame:
    """Later holders of a name get `` 1``, `` 2`` and so on: the first that no earlier row has.

    Holders of a name are numbered; a number whose name an earlier row of another base name has is
    skipped by the rows that follow. Base names meet only if they differ in numbers at the end: among
    those the earliest row without a name of its own is settled, and this repeats until all names differ.
    """
    place = cut(ranked(named, name, [F.col(order)]))
    kind = named.schema[order].dataType.simpleString()
    skipped = place.sparkSession.createDataFrame([], f"base string, skip bigint, since {kind}")
    while True:
        gaps = skipped.groupBy("base").agg(F.array_sort(F.collect_set(F.struct("skip", "since"))).alias("gaps"))
        rows = place.join(broadcast_if_small(cut(gaps)), place[name] == F.col("base"), "left")
        passed = F.filter(F.coalesce("gaps", F.array().cast(f"array<struct<skip:bigint,since:{kind}>>")), lambda gap: gap["since"] < F.col(order))
        number = F.aggregate(passed, F.col("place").cast("bigint"), lambda n, gap: F.when(gap["skip"] <= n, n + 1).otherwise(n))
        suffix = F.when(F.col("number") == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("number").cast("string")))
        rows = cut(rows.withColumn("number", number).select(*place.columns, "number", F.concat(F.col(name), suffix).alias("unique_name")))
        # Rows of one base name differ; a name held twice is held under two base names, and the earlier row keeps it.
        first = rows.groupBy("unique_name").agg(F.count(F.lit(1)).alias("holders"), F.min(order).alias("since")).where("holders > 1")
        clash = rows.join(broadcast_if_small(cut(first)), "unique_name").where(F.col(order) > F.col("since"))
        root = F.regexp_replace(name, "( [0-9]+)+$", "").alias("root")
        clash = cut(clash.groupBy(root).agg(F.min_by(F.struct(F.col(name).alias("base"), F.col("number").alias("skip"), "since"), order).alias("c")).select("c.*"))
        if clash.isEmpty():
            return rows.drop("place", "number")
        skipped = skipped.unionByName(clash)


def snippet(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def domain_snippets(rows: DataFrame) -> DataFrame:
    """``(cluster, id, snippet)`` from ``(cluster, id, file, code, atomic_features)``."""
    header = F.concat(F.lit("// File: "), F.col("file"), F.lit("\n"))
    features = F.concat(F.lit("// Atomic features: "), F.array_join("atomic_features", ", "))
    body = F.when(F.coalesce("code", F.lit("")) != "", F.concat(header, snippet(F.col("code"), DOMAIN_SNIPPET))).when(
        F.size("atomic_features") > 0, features
    )
    return rows.select("cluster", "id", body.alias("snippet")).where("snippet is not null")


def feature_snippets(rows: DataFrame) -> DataFrame:
    """At most eleven snippets per feature from ``(feature_id, id, code, atomic_features)``."""
    header = F.when(
        F.size("atomic_features") > 0,
        F.concat(F.lit("// Atomic features: "), F.array_join("atomic_features", ", "), F.lit("\n")),
    ).otherwise(F.lit(""))
    body = F.concat(header, F.coalesce(snippet(F.col("code"), FEATURE_SNIPPET), F.lit("")))
    order = W.partitionBy("feature_id").orderBy("id")
    return (
        rows.select("feature_id", "id", body.alias("snippet"))
        .where("snippet <> ''")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= FEATURE_SNIPPETS)
        .drop("n")
    )


def _short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 16))


def clusterable(graph: PropertyGraph) -> DataFrame:
    """Functions with metadata and a vector."""
    return function_metadata(graph).join(embeddings_only(graph), "id").withColumnRenamed("embedding", "vec")


def build_topology(graph: PropertyGraph, root: str = ".", seed: int = 42, max_iterations: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the domain and feature layer over the embedded functions."""
    functions = cut(clusterable(graph))
    total = functions.count()
    k = functions.agg(F.countDistinct("file").alias("files")).select(domain_count(F.col("files"))).first()[0]
    if total <= 3:
        level = functions.select("id", F.lit(0).alias("cluster"))
    else:
        level = kmeans(functions.select("id", "vec"), min(max(k, 2), total // 2), seed, max_iterations)
    domains = cut(functions.join(level, "id").select(F.col("cluster").cast("string").alias("grp"), "id", "vec", "name", "file"))

    lcas = common_ancestor(domains.where("file is not null"), ["grp"], "file")
    lcas = domains.select("grp").distinct().join(lcas, "grp", "left").select(
        "grp", F.coalesce(F.nullif("lca", F.lit("")), F.lit(root)).alias("lca")
    )
    named = domain_names(lcas, dominant_terms(domains, ["grp"]), ["grp"])
    domain_id = _short_id("domain-", F.lit(str(seed)), F.col("grp"))
    domain_nodes = named.select(
        domain_id.alias("id"), F.lit("Domain").alias("label"), F.col("domain_name").alias("name"),
        F.lit("").alias("description"), F.col("lca").alias("scope_path"),
    )

    features = cut(cluster_groups(domains.select("grp", "id", "vec"), seed, max_iterations))
    feature_id = _short_id("feature-", F.lit(str(seed)), F.col("grp"), F.col("cluster").cast("string"))
    placed = features.select("grp", "id", feature_id.alias("feature_id"))
    feature_rows = placed.select("grp", "feature_id").distinct().join(lcas, "grp")
    feature_nodes = feature_rows.select(
        F.col("feature_id").alias("id"), F.lit("Feature").alias("label"), F.lit("").alias("name"),
        F.lit("").alias("description"), F.col("lca").alias("scope_path"),
    )
    parent_of = feature_rows.select(domain_id.alias("src"), F.col("feature_id").alias("dst"), F.lit("PARENT_OF").alias("type"))
    implements = placed.select(F.col("id").alias("src"), F.col("feature_id").alias("dst"), F.lit("IMPLEMENTS").alias("type"))
    return conform_nodes(domain_nodes.unionByName(feature_nodes)), parent_of.unionByName(implements)


def run_clustering(graph: PropertyGraph, root: str = ".", seed: int = 42) -> PropertyGraph:
    """Replace the layer of the graph by a fresh one."""
    cleared = clear_topology(graph)
    nodes, edges = build_topology(cleared, root, seed)
    return update_topology(cleared, nodes, edges)
