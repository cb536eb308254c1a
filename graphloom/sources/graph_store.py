"""A stored graph that takes small changes: Parquet in hash buckets, and a manifest for every state.

Nodes lie in buckets by their id, edges by their source. A change reads the buckets it touches, writes them anew beside the old ones and
then adds a manifest: one small table, one file, that names the folder of every bucket. A state exists when its manifest
does, so a change that fails leaves the state before it as it was, and a reader keeps the state it
began with. Buckets that nothing touches are neither read nor written. Two changes made on the same state: the second to end fails.

Edges are stored as they were given and resolved against all nodes when read, so an edge may come before its ends.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.model import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph, conform_edges
from graphloom.operators.upsert import resolve_edges, upsert_nodes
from graphloom.session import broadcast_if_small, cut

BUCKETS = 64
SCHEMAS: dict[str, StructType] = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA}
KEYS = {"nodes": "id", "edges": "src"}
_MANIFEST = "generation long, epoch long, buckets int, kind string, bucket int, folder string, rows long"


class GraphStore:
    """One state of the store at ``path``: the last one, or that of ``generation``. Changes return the state they make."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, generation: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        listed = self._manifests()
        if listed is not None and generation is None:
            generation = listed.agg(F.max("generation")).first()[0]
        rows = listed.where(F.col("generation") == generation).collect() if generation is not None else []
        if generation is not None and not rows:
            raise ValueError(f"no generation {generation} in {path}")
        self.generation = generation
        self.epoch = rows[0]["epoch"] if rows else None
        self.buckets = rows[0]["buckets"] if rows else buckets
        #: Folder and rows of each bucket, by kind and bucket.
        self.parts = {(r["kind"], r["bucket"]): (r["folder"], r["rows"]) for r in rows if r["folder"] is not None}

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, buckets: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for (k, b), (folder, _) in sorted(self.parts.items()) if k == kind and (buckets is None or b in buckets)]
        return self.spark.read.schema(SCHEMAS[kind]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[kind])

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes")

    @property
    def given_edges(self) -> DataFrame:
        """Edges as they were given: an end may be unknown, a target may be a qualified name."""
        return self._read("edges")

    def graph(self) -> PropertyGraph:
        return PropertyGraph(self.nodes, resolve_edges(self.nodes, self.given_edges))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Nodes of ``ids(id)``; only their buckets are read."""
        ids = cut(ids.select("id").distinct())
        return self._read("nodes", self._touched(ids, "id")).join(broadcast_if_small(ids), "id", "left_semi")

    def _touched(self, rows: DataFrame, key: str) -> set[int]:
        """Buckets of the rows: a bounded set, whatever the rows."""
        return {r[0] for r in rows.select(self.bucket(key)).distinct().collect()}

    def _written(self, kind: str, rows: DataFrame, generation: int) -> dict:
        folder = f"{kind}/g{generation:010d}-{uuid.uuid4().hex[:12]}"
        placed = rows.withColumn("bucket", self.bucket(KEYS[kind])).repartition("bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        # Files know how many rows they hold: nothing is read for it but their ends.
        schema = StructType([*SCHEMAS[kind].fields, *StructType.fromDDL("bucket int").fields])
        counts = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()
        return {(kind, r["bucket"]): (f"{folder}/bucket={r['bucket']}", r["count"]) for r in counts}

    def _commit(self, generation: int, parts: dict, epoch: int | None) -> GraphStore:
        rows = [(generation, epoch, self.buckets, kind, bucket, folder, n) for (kind, bucket), (folder, n) in sorted(parts.items())]
        rows = rows or [(generation, epoch, self.buckets, "nodes", None, None, 0)]
        # One file, put in place as a whole; a folder that is there already is another's state.
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/state={generation:010d}")
        return GraphStore(self.spark, self.path, self.buckets, generation)

    def _next(self) -> int:
        return 0 if self.generation is None else self.generation + 1

    def apply(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, gone: DataFrame | None = None, epoch: int | None = None) -> GraphStore:
        """The state after a change: ``gone(id)`` is taken out with its edges, ``nodes`` (with ``seq``) are merged in, ``edges`` are added.

        An ``epoch`` that is not beyond the stored one was applied before: nothing happens.
        """
        if epoch is not None and self.epoch is not None and epoch <= self.epoch:
            return self
        generation, parts = self._next(), dict(self.parts)
        gone = cut(gone.select("id").distinct()) if gone is not None else None
        nodes = cut(nodes) if nodes is not None else None
        edges = cut(conform_edges(edges).where("src <> '' and dst <> ''").distinct()) if edges is not None else None

        touched = (self._touched(nodes, "id") if nodes is not None else set()) | (self._touched(gone, "id") if gone is not None else set())
        cut_edges: set[int] = set()
        doomed = None
        if gone is not None:
            doomed = self._edges_at(gone)
            cut_edges = self._touched(doomed, "src")
        if touched:
            kept = self._read("nodes", touched)
            if gone is not None:
                kept = kept.join(broadcast_if_small(gone), "id", "left_anti")
            if nodes is not None:
                kept = upsert_nodes(PropertyGraph(kept, self.given_edges), nodes).nodes
            parts = {k: v for k, v in parts.items() if k[0] != "nodes" or k[1] not in touched} | self._written("nodes", kept, generation)
        cut_edges |= self._touched(edges, "src") if edges is not None else set()
        if cut_edges:
            kept = self._read("edges", cut_edges)
            if doomed is not None:
                kept = kept.join(broadcast_if_small(doomed), ["src", "dst", "type"], "left_anti").select("src", "dst", "type")
            if edges is not None:
                known = kept.join(broadcast_if_small(edges), ["src", "dst", "type"], "left_semi").select("src", "dst", "type")
                kept = kept.unionByName(edges.join(known, ["src", "dst", "type"], "left_anti").select("src", "dst", "type"))
            parts = {k: v for k, v in parts.items() if k[0] != "edges" or k[1] not in cut_edges} | self._written("edges", kept, generation)
        return self._commit(generation, parts, self.epoch if epoch is None else epoch)

    def _edges_at(self, gone: DataFrame) -> DataFrame:
        """Edges from or to nodes that go; one to a name goes when no other node bears it. Edges are scanned, none is moved."""
        lost = self.lookup(gone).where("fqn is not null").select("fqn").distinct()
        bearers = self.nodes.select("id", "fqn").join(broadcast_if_small(lost), "fqn", "left_semi").join(broadcast_if_small(gone), "id", "left_anti").select("fqn")
        ends = cut(gone.select("id").unionByName(lost.join(bearers, "fqn", "left_anti").select(F.col("fqn").alias("id"))).distinct())
        stored = self.given_edges
        at = stored.join(broadcast_if_small(gone.withColumnRenamed("id", "src")), "src", "left_semi").select("src", "dst", "type")
        to = stored.join(broadcast_if_small(ends.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst", "type")
        return cut(at.unionByName(to).distinct())

    def compact(self, least_rows: int = 100_000) -> GraphStore:
        """A state with half as many buckets, and half again, until a bucket has ``least_rows`` rows on average; the same if it has."""
        rows = max(sum(n for (kind, _), (_, n) in self.parts.items() if kind == k) for k in SCHEMAS)
        buckets = self.buckets
        while buckets % 2 == 0 and rows < least_rows * buckets:
            buckets //= 2
        if buckets == self.buckets:
            return self
        generation = self._next()
        smaller = GraphStore(self.spark, self.path, generation=self.generation)
        smaller.buckets = buckets
        parts = reduce(lambda a, b: a | b, (smaller._written(kind, self._read(kind), generation) for kind in SCHEMAS))
        return smaller._commit(generation, parts, self.epoch)

    def vacuum(self, states: int = 1) -> int:
        """Delete what the last ``states`` states do not need, also what failed changes left. Returns how many folders went."""
        there = sorted(r[0] for r in self._manifests().select("generation").distinct().collect())[-states:]
        kept = [GraphStore(self.spark, self.path, generation=g) for g in there]
        needed = {folder.split("/bucket=")[0] for s in kept for folder, _ in s.parts.values()}
        needed |= {f"manifest/state={s.generation:010d}" for s in kept}
        jvm = self.spark.sparkContext._jvm
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files, went = root.getFileSystem(hadoop), 0
        # Manifests first: a state whose folders go is no longer named.
        for top in ("manifest", *SCHEMAS):
            here = jvm.org.apache.hadoop.fs.Path(root, top)
            for status in files.listStatus(here) if files.exists(here) else []:
                name = status.getPath().getName()
                if status.isDirectory() and not name.startswith("_") and f"{top}/{name}" not in needed:
                    went += bool(files.delete(status.getPath(), True))
        return went
