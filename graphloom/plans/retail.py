"""The benchmark tables seen as a code-like property graph.

Every line of ``lineitem`` is an edge: to the part on the next line of its order, to its
supplier, and, for single-piece lines, to the nation of its supplier. The SQL in
:data:`GRAPH_SQL` states the same graph for the check engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import PropertyGraph, conform_nodes
from graphloom.session import shares


# Lines that one task joins.
LINES = 500_000
# Schemas read from footers once per path; later reads start no job for them.
_SCHEMAS: dict[str, T.StructType] = {}


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        frame = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        setattr(self, name, frame)
        return frame


def text(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def function_rows(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select(
        text("fn:", "p_partkey").alias("id"),
        F.lit("Function").alias("label"),
        F.concat("p_name", F.lit(" "), F.floor(F.col("p_partkey") / 100).cast("string")).alias("name"),
        text("part.", "p_partkey").alias("fqn"),
        F.col("p_brand").alias("file"),
        F.when(size % 11 != 0, size.cast("bigint")).alias("start_line"),
        (size + 10).cast("bigint").alias("end_line"),
        F.when(size >= 48, F.lit(True)).when(size >= 10, F.lit(False)).alias("is_volatile"),
        F.when(size % 7 == 0, F.array(F.lit("unknown")))
        .when(size % 5 != 0, F.array(F.lower("p_type"), F.lower("p_name")))
        .alias("atomic_features"),
        F.concat("p_name", F.lit(" "), "p_type").alias("content"),
    )


def node_parts(t: Tables) -> dict:
    n = F.col("n_nationkey")
    described = F.when(n % 3 == 0, F.lit("")).when(n % 3 == 2, F.concat(F.lit("about "), "n_name"))
    return {
        "Function": lambda: function_rows(t),
        "File": lambda: t.part.select("p_brand").distinct().selectExpr(
            "concat('file:', p_brand) as id", "'File' as label", "p_brand as name", "p_brand as file"
        ),
        "Class": lambda: t.part.select("p_type").distinct().selectExpr(
            "concat('cls:', p_type) as id", "'Class' as label", "p_type as name"
        ),
        "Global": lambda: t.supplier.selectExpr(
            "concat('gv:', s_suppkey) as id", "'Global' as label", "s_name as name", "concat('globals/', s_nationkey) as file"
        ),
        "Feature": lambda: t.nation.select(
            text("feat:", "n_nationkey").alias("id"), F.lit("Feature").alias("label"), F.col("n_name").alias("name"),
            described.alias("description"),
        ),
        "Domain": lambda: t.region.selectExpr(
            "concat('dom:', r_regionkey) as id", "'Domain' as label", "r_name as name",
            "concat('region ', r_name) as description",
        ),
    }


# What a line is to the next line of its order. The three cases share no row.
LINE_KINDS = {
    "CALLS": "l_quantity <= 5 and l_returnflag = 'R'",
    "USES": "l_quantity <= 5 and l_returnflag = 'A'",
    "DEPENDS_ON": "not (l_quantity <= 5 and l_returnflag in ('R', 'A'))",
}


def line_edges(t: Tables, condition: str) -> DataFrame:
    """Edges from the part of each matching line to the parts on the next line number.

    The condition is a plain filter on the scan, and both sides are reduced to what the
    join needs before it.
    """
    here = t.lineitem.where(condition).selectExpr("l_orderkey", "l_linenumber + 1 as l_linenumber", "l_partkey as a")
    there = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey as b")
    pairs = here.join(there, ["l_orderkey", "l_linenumber"]).where("a <> b").select("a", "b").distinct()
    return pairs.selectExpr("concat('fn:', a) as src", "concat('fn:', b) as dst")


def supplier_edges(t: Tables, condition: str) -> DataFrame:
    pairs = t.lineitem.where(condition).select("l_partkey", "l_suppkey").distinct()
    return pairs.selectExpr("concat('fn:', l_partkey) as src", "concat('gv:', l_suppkey) as dst")


def nation_edges(t: Tables) -> DataFrame:
    home = t.supplier.selectExpr("s_suppkey as l_suppkey", "s_nationkey")
    pairs = t.lineitem.where("l_quantity <= 1").select("l_partkey", "l_suppkey").distinct().join(home, "l_suppkey")
    return pairs.select("l_partkey", "s_nationkey").distinct().selectExpr(
        "concat('fn:', l_partkey) as src", "concat('feat:', s_nationkey) as dst"
    )


def edge_parts(t: Tables) -> dict:
    return {
        **{kind: (lambda c=condition: line_edges(t, c)) for kind, condition in LINE_KINDS.items()},
        "USES_GLOBAL": lambda: supplier_edges(t, "l_quantity <= 2"),
        "REFERENCES": lambda: supplier_edges(t, "l_quantity > 2"),
        "IMPLEMENTS": lambda: nation_edges(t),
        "DEFINED_IN": lambda: t.part.selectExpr("concat('fn:', p_partkey) as src", "concat('file:', p_brand) as dst"),
        "HAS_METHOD": lambda: t.part.selectExpr("concat('cls:', p_type) as src", "concat('fn:', p_partkey) as dst"),
        "PARENT_OF": lambda: t.nation.selectExpr("concat('dom:', n_regionkey) as src", "concat('feat:', n_nationkey) as dst"),
    }


def retail_graph(t: Tables) -> PropertyGraph:
    return PropertyGraph(node_parts=node_parts(t), edge_parts=edge_parts(t))


GRAPH_SQL = {
    "fn": """fn AS (SELECT 'fn:' || p_partkey AS id, 'Function' AS label,
        p_name || ' ' || (p_partkey // 100) AS name, 'part.' || p_partkey AS fqn, p_brand AS file,
        CASE WHEN p_size % 11 <> 0 THEN p_size END AS start_line, p_size + 10 AS end_line,
        CASE WHEN p_size >= 48 THEN true WHEN p_size >= 10 THEN false END AS is_volatile,
        CASE WHEN p_size % 7 = 0 THEN ['unknown'] WHEN p_size % 5 <> 0 THEN [lower(p_type), lower(p_name)] END AS af,
        p_name || ' ' || p_type AS content, NULL::VARCHAR AS description FROM part)""",
    "nodes": """nodes AS (SELECT id, label, name, fqn, file, start_line, end_line, is_volatile, af, description FROM fn
        UNION ALL SELECT DISTINCT 'file:' || p_brand, 'File', p_brand, NULL, p_brand, NULL, NULL, NULL, NULL, NULL FROM part
        UNION ALL SELECT DISTINCT 'cls:' || p_type, 'Class', p_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
        UNION ALL SELECT 'gv:' || s_suppkey, 'Global', s_name, NULL, 'globals/' || s_nationkey, NULL, NULL, NULL, NULL, NULL FROM supplier
        UNION ALL SELECT 'feat:' || n_nationkey, 'Feature', n_name, NULL, NULL, NULL, NULL, NULL, NULL,
            CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 2 THEN 'about ' || n_name END FROM nation
        UNION ALL SELECT 'dom:' || r_regionkey, 'Domain', r_name, NULL, NULL, NULL, NULL, NULL, NULL, 'region ' || r_name FROM region)""",
    "steps": """steps AS (SELECT DISTINCT 'fn:' || a.l_partkey AS src, 'fn:' || b.l_partkey AS dst,
        CASE WHEN a.l_quantity <= 5 AND a.l_returnflag = 'R' THEN 'CALLS'
             WHEN a.l_quantity <= 5 AND a.l_returnflag = 'A' THEN 'USES' ELSE 'DEPENDS_ON' END AS type
        FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_partkey <> b.l_partkey)""",
    "edges": """edges AS (SELECT src, dst, type FROM steps
        UNION ALL SELECT DISTINCT 'fn:' || l_partkey, 'gv:' || l_suppkey,
            CASE WHEN l_quantity <= 2 THEN 'USES_GLOBAL' ELSE 'REFERENCES' END FROM lineitem
        UNION ALL SELECT DISTINCT 'fn:' || l_partkey, 'feat:' || s_nationkey, 'IMPLEMENTS'
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity <= 1
        UNION ALL SELECT 'fn:' || p_partkey, 'file:' || p_brand, 'DEFINED_IN' FROM part
        UNION ALL SELECT 'cls:' || p_type, 'fn:' || p_partkey, 'HAS_METHOD' FROM part
        UNION ALL SELECT 'dom:' || n_regionkey, 'feat:' || n_nationkey, 'PARENT_OF' FROM nation)""",
    "calls": "calls AS (SELECT src, dst FROM steps WHERE type = 'CALLS')",
}
PARTS = ("fn", "nodes", "steps", "edges", "calls")


def graph_sql(query: str, *more: str, recursive: bool = False) -> str:
    """A statement over the graph, with further common table expressions."""
    ctes = [GRAPH_SQL[p] for p in PARTS] + list(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {query}"


# ---- inclusion graph -------------------------------------------------------------------


def include_graph(t: Tables) -> PropertyGraph:
    """Customers as files; an urgent order includes the file of the next order."""
    files = t.customer.select(
        text("File:c", "c_custkey").alias("id"), F.lit("File").alias("label"),
        text("c", "c_custkey").alias("name"), text("c", "c_custkey").alias("file"),
    )
    here = t.orders.where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("a"))
    there = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("b"))
    edges = here.join(there, "k").where("a <> b").select("a", "b").distinct().select(
        text("File:c", "a").alias("src"), text("File:c", "b").alias("dst"), F.lit("INCLUDES").alias("type")
    )
    return PropertyGraph(conform_nodes(files), edges)


INCLUDE_SQL = """inc AS (SELECT DISTINCT 'c' || a.o_custkey AS src, 'c' || b.o_custkey AS dst
    FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
    WHERE a.o_orderpriority = '1-URGENT' AND a.o_custkey <> b.o_custkey)"""


# ---- change history --------------------------------------------------------------------


def touches(t: Tables) -> DataFrame:
    """Every line is a file (brand) mentioned by a commit (order)."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("p_partkey"))
    dates = t.orders.select(F.col("o_orderkey").alias("commit"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("changed_at"))
    tasks = shares(t.lineitem, LINES)
    return (
        lines.repartition(tasks, "p_partkey")
        .join(t.part.select("p_partkey", F.col("p_brand").alias("file")), "p_partkey")
        .repartition(tasks, "commit")
        .join(dates, "commit")
        .select("commit", "changed_at", "file")
    )


TOUCH_SQL = """touches AS (SELECT l_orderkey AS "commit", strftime(o_orderdate, '%Y-%m-%d') AS changed_at,
    p_brand AS file, row_number() OVER () AS rid
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""
CHURN_SQL = "churn AS (SELECT file, count(*) AS churn, max(changed_at) AS last_changed FROM touches GROUP BY file)"


# ---- vectors ---------------------------------------------------------------------------


def vector_graph(t: Tables) -> PropertyGraph:
    """Embedded functions in one file per label, linked twice for even ids."""
    vectors = t.embeddings
    functions = vectors.select(
        text("fn:", "vec_id").alias("id"), F.lit("Function").alias("label"), text("vector_", "vec_id").alias("name"),
        F.concat(F.lit("topics/"), F.col("label").cast("string"), F.lit("/f"), (F.col("vec_id") % 7).cast("string")).alias("file"),
        F.col("embedding"), F.array(text("topic ", "label")).alias("atomic_features"),
    )
    files = vectors.select("label").distinct().select(
        text("file:topic", "label").alias("id"), F.lit("File").alias("label"), text("topic", "label").alias("name")
    )
    located = vectors.select(text("fn:", "vec_id").alias("src"), text("file:topic", "label").alias("dst"), F.lit("DEFINED_IN").alias("type"))
    defines = vectors.where("vec_id % 2 = 0").select(
        text("file:topic", "label").alias("src"), text("fn:", "vec_id").alias("dst"), F.lit("DEFINES").alias("type")
    )
    nodes = conform_nodes(functions).unionByName(conform_nodes(files))
    return PropertyGraph(nodes, located.unionByName(defines))


def label_means(t: Tables) -> DataFrame:
    """A feature per label with the mean vector, for feature search."""
    x = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    means = x.groupBy("label", "dim").agg(F.avg("x").alias("x")).groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d")
    )
    return means.select(
        text("feat:", "label").alias("id"), F.lit("Feature").alias("label"), text("topic ", "label").alias("name"),
        F.transform("d", lambda e: e["x"]).alias("embedding"),
    )


VECTOR_SQL = """vecs AS (SELECT vec_id, 'fn:' || vec_id AS id, 'vector_' || vec_id AS name, label, embedding::DOUBLE[] AS v FROM embeddings)"""
COS_SQL = "list_cosine_similarity"
