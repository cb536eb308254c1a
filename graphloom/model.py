"""The property graph: two DataFrames with a fixed schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut

NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("label", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("name", T.StringType()),
        T.StructField("fqn", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("is_test", T.BooleanType()),
        T.StructField("is_volatile", T.BooleanType()),
        T.StructField("volatility_score", T.DoubleType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("change_frequency", T.LongType()),
        T.StructField("last_changed", T.StringType()),
        T.StructField("co_changes", T.ArrayType(T.StringType())),
        T.StructField("atomic_features", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("description", T.StringType()),
        T.StructField("scope_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
    ]
)
NODE_COLUMNS = [f.name for f in NODE_SCHEMA]
SUPER_LABEL = "CodeElement"


def conform_nodes(df: DataFrame) -> DataFrame:
    """Add missing node columns as typed nulls and order the columns."""
    have = set(df.columns)
    exprs = []
    for field in NODE_SCHEMA:
        kind = field.dataType.simpleString()
        if field.name in have:
            exprs.append(f"cast(`{field.name}` as {kind}) as `{field.name}`")
        elif field.name == "labels":
            exprs.append(f"array(label, '{SUPER_LABEL}') as labels")
        else:
            exprs.append(f"cast(null as {kind}) as `{field.name}`")
    return df.selectExpr(*exprs)


def conform_edges(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"cast(`{f.name}` as string) as `{f.name}`" for f in EDGE_SCHEMA])


def sanitize_label(label):
    """Keep only letters, digits and underscores of a label column."""
    return F.regexp_replace(label, "[^A-Za-z0-9_]", "")


Parts = Mapping[str, Callable[[], DataFrame]]


class PropertyGraph:
    """An immutable graph; enrichments return a new one.

    A graph is two frames, or a mapping from label (edge type) to the frame of that part,
    as in storage partitioned by it. Parts are only built, and so only read, when asked
    for; ``nodes`` and ``edges`` are the unions of all.
    """

    def __init__(
        self,
        nodes: DataFrame | None = None,
        edges: DataFrame | None = None,
        node_parts: Parts | None = None,
        edge_parts: Parts | None = None,
    ):
        self._nodes, self._edges = nodes, edges
        self._node_parts, self._edge_parts = node_parts, edge_parts
        self._built: dict[str, DataFrame] = {}

    def _node_part(self, label: str) -> DataFrame:
        if (key := f"node {label}") not in self._built:
            self._built[key] = conform_nodes(self._node_parts[label]())
        return self._built[key]

    def _edge_part(self, kind: str) -> DataFrame:
        if (key := f"edge {kind}") not in self._built:
            self._built[key] = self._edge_parts[kind]().selectExpr("src", "dst", f"'{kind}' as type")
        return self._built[key]

    @property
    def nodes(self) -> DataFrame:
        if self._nodes is None:
            self._nodes = reduce(DataFrame.unionByName, [self._node_part(k) for k in self._node_parts])
        return self._nodes

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = reduce(DataFrame.unionByName, [self._edge_part(k) for k in self._edge_parts])
        return self._edges

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def labelled(self, *labels: str) -> DataFrame:
        """Nodes whose canonical label is one of ``labels``."""
        known = [k for k in labels if k in (self._node_parts or {})]
        if known:
            return reduce(DataFrame.unionByName, [self._node_part(k) for k in known])
        return self.nodes.where(F.col("label").isin(*labels))

    def of_type(self, *types: str) -> DataFrame:
        """Edges of the given types; of all types when none is given."""
        if not types:
            return self.edges
        known = [k for k in types if k in (self._edge_parts or {})]
        if known:
            return reduce(DataFrame.unionByName, [self._edge_part(k) for k in known])
        return self.edges.where(F.col("type").isin(*types))

    def with_nodes(self, nodes: DataFrame) -> PropertyGraph:
        return PropertyGraph(nodes, self._edges, None, self._edge_parts)

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(self._nodes, edges, self._node_parts, None)

    def with_part(self, label: str, rows: DataFrame) -> PropertyGraph:
        """Replace all nodes of one label."""
        if self._node_parts and label in self._node_parts:
            return PropertyGraph(None, self._edges, {**self._node_parts, label: lambda: rows}, self._edge_parts)
        rest = self.nodes.where((F.col("label") != label) | F.col("label").isNull())
        return self.with_nodes(rest.unionByName(conform_nodes(rows)))

    def pin(self, *types: str) -> PropertyGraph:
        """The same graph with edges of some types written out once, for repeated use."""
        rest = {k: v for k, v in (self._edge_parts or {}).items() if k not in types}
        if not self._edge_parts:
            other = self.edges.where(~F.col("type").isin(*types))
            return self.with_edges(cut(self.of_type(*types)).unionByName(other))
        pinned = {k: cut(self._edge_part(k).distinct()) for k in types if k in self._edge_parts}
        parts = {**rest, **{k: (lambda df=df: df) for k, df in pinned.items()}}
        return PropertyGraph(self._nodes, None, self._node_parts, parts)

    def settle(self) -> PropertyGraph:
        """The graph written out, so that a further step does not replay the earlier ones."""
        return PropertyGraph(cut(self.nodes), cut(self.edges))

    def public_nodes(self) -> DataFrame:
        """Nodes as shown to a client: without the embedding."""
        return self.nodes.drop("embedding")

    def register_views(self, nodes: str = "nodes", edges: str = "edges") -> None:
        self.nodes.createOrReplaceTempView(nodes)
        self.edges.createOrReplaceTempView(edges)
