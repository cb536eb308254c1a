"""A stored vector index: vectors in cells around coarse centroids, a folder for each cell.

Centroids come from a bounded sample; every vector is stored in the cell of the nearest, and a cell knows the largest
angle between its centroid and a vector of it. A search compares its vector with the centroids and reads folders of cells alone. With ``probes`` it
reads that many cells and may miss some; without, it is exact: cells are read from the lowest bound on the angle up, and those whose
bound exceeds the angle of the last vector found cannot hold a nearer one. Vectors without a length are not stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import as_double, cosine_score, is_zero, norm, vector_literal
from graphloom.operators.kmeans import _pass, _stack, cosine_distances, seed_centroids
from graphloom.session import cut

#: Cells at most: tasks and driver hold their centroids. Sampled vectors for each, and passes over them.
MOST_CELLS, SAMPLED_EACH, PASSES = 4096, 64, 4
#: Rows of a file of a cell, about; a larger cell has more files.
FILE_ROWS = 500_000
#: Angles are compared with this much to spare.
SLACK = 1e-6
_CELLS = "cell int, centroid array<double>, radius double, rows long"


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=-1, keepdims=True)


def _angles(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(1 - cosine_distances(rows, to), -1, 1))


def build_index(nodes: DataFrame, path: str, cells: int | None = None, seed: int = 42) -> VectorIndex:
    """Store ``nodes(id, label, embedding)`` under ``path``; about as many cells as the root of their number."""
    spark = nodes.sparkSession
    vectors = nodes.where(F.col("embedding").isNotNull()).where(norm(F.col("embedding")) > 0).select("id", "label", "embedding")
    n = vectors.count()
    k = min(MOST_CELLS, n, cells or ceil(sqrt(n)))
    if k:
        share = min(1.0, 1.2 * SAMPLED_EACH * k / n)
        drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
        sample = cut(vectors.where(drawn).select("id", as_double(F.col("embedding")).alias("vec")))
        sample = sample if sample.count() >= k else cut(vectors.select("id", as_double(F.col("embedding")).alias("vec")))
        centroids = seed_centroids(sample, k, seed)
        for _ in range(PASSES):
            centroids = _pass(sample, centroids)
        # A mean may have no length; its seed's direction does for such a cell.
        centroids = np.where(np.linalg.norm(centroids, axis=1, keepdims=True) > 0, centroids, np.eye(1, centroids.shape[1]))
    else:
        centroids = np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(_unit(centroids) if k else centroids)

    def place(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            angle = _angles(_stack(pdf["embedding"]), shared.value)
            cell = angle.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), angle=angle[np.arange(len(pdf)), cell])

    schema = "id string, label string, embedding array<float>, cell int, angle double"
    placed = cut(vectors.mapInPandas(place, schema))
    stats = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows"))
    found = {r["cell"]: r for r in stats.collect()}
    rows = [(c, [float(x) for x in shared.value[c]], float(r["radius"]), r["rows"]) for c, r in sorted(found.items())]
    # A cell that holds much of the table is dealt out over files by its rows.
    files = spark.createDataFrame([(c, ceil(n / FILE_ROWS)) for c, _, _, n in rows], "cell int, files long")
    dealt = placed.join(F.broadcast(files), "cell").repartition("cell", F.pmod(F.xxhash64("id"), "files"))
    dealt.select("id", "label", "embedding", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    # The index exists when its cells do.
    spark.createDataFrame(rows, _CELLS).coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(spark, path)


class VectorIndex:
    """A stored index; its cells are held by the driver, a bounded number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema(_CELLS).parquet(f"{path}/cells").orderBy("cell").collect()
        self.cells = [r["cell"] for r in rows]
        self.centroids = np.array([r["centroid"] for r in rows])
        self.radii, self.sizes = np.array([r["radius"] for r in rows]), np.array([r["rows"] for r in rows], np.int64)

    def read(self, which: Sequence[int]) -> DataFrame:
        """Vectors of some cells, by their places in ``cells``; no other folder is looked at."""
        schema = "id string, label string, embedding array<float>"
        paths = [f"{self.path}/vectors/cell={self.cells[i]}" for i in which]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _best(self, which: Sequence[int], vector: Sequence[float], k: int) -> DataFrame:
        score = cosine_score(F.col("embedding"), vector_literal(vector)).alias("score")
        return self.read(which).select("id", "label", score).orderBy(F.desc("score"), "id").limit(k)

    def nearest(self, vector: Sequence[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """``(id, label, score)`` of the ``k`` nearest, ties to the smaller id; of ``probes`` cells, or exactly."""
        if is_zero(vector) or not self.cells or k < 1:
            return self.spark.createDataFrame([], "id string, label string, score double")
        angle = _angles(np.array([vector], float), self.centroids)[0]
        if probes is not None:
            return self._best(np.argsort(angle, kind="stable")[:probes].tolist(), vector, k)
        bound = np.maximum(0, angle - self.radii - SLACK)
        order = np.argsort(bound, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1]
        found = cut(self._best(first.tolist(), vector, k))
        last = found.agg(F.min("score"), F.count(F.lit(1))).first()
        limit = np.arccos(np.clip(2 * last[0] - 1, -1, 1)) + SLACK if last[1] == k else np.pi
        rest = [i for i in order[len(first) :].tolist() if bound[i] <= limit]
        return found.unionByName(self._best(rest, vector, k)).orderBy(F.desc("score"), "id").limit(k) if rest else found
