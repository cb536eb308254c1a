"""Approximate nearest neighbours by a permutation index.

A vector is described by the order of all reference points by their distance, and posted in the inverted
files of its first few. A query visits the files of its own first reference points; a vector that
stands in several of them is looked at in one. In each file the vectors are ranked by the footrule
distance of the two orders, and a share of them, the best, is ranked again by
Euclidean distance in double precision. Files and queries are cut into blocks, which meet in
groups of bounded size. Queries for which fewer neighbours than asked for were found are run again against all
files without a limit.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither do rows without a key; vectors of different lengths are no neighbours. Ties go to the smaller
key. Rows that repeat a key or a vector are rows of their own. Empty tables give no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.pivots import order, reference_points, usable
from graphloom.llm.support import written

PIVOTS = 256
#: Files that a vector stands in, and that a query visits.
POSTED, VISITED = 8, 32
#: Of a block of a file, the share that is ranked again, and at least so many.
SHARE, LEAST = 0.15, 20
#: Orders closer than this part of what two random orders differ by are always ranked again: near copies differ too little to tell.
CLOSE = 0.3
BLOCK, QUERY_BLOCK = 4096, 512
SEED = 41


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_pylist()]


def posts(rows: DataFrame, pivots: np.ndarray, first: int) -> DataFrame:
    """``r, pivot``: the files of each row's ``first`` nearest reference points; vectors of an uncommon length share one file."""
    points = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, near = _vectors(batch.column(1)), [None] * batch.num_rows
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                found = order(np.array([vectors[i] for i in at]), points.value, first) if size == points.value.shape[1] else np.full((len(at), 1), -size)
                for i, x in zip(at, found.tolist()):
                    near[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.list_(pa.int32()))], ["r", "near"])

    return rows.select("r", "v").mapInArrow(run, "r long, near array<int>").select("r", F.explode("near").alias("pivot"))


def _search(queries: DataFrame, rows: DataFrame, pivots: np.ndarray, k: int, visited: int, posted: int, share: float, block: int, query_block: int) -> DataFrame:
    """``q, r, score``: the nearest found of each query in each file."""
    points = rows.sparkSession.sparkContext.broadcast(pivots)
    files = written(posts(rows, pivots, posted).join(rows, "r"), "files")
    asked = written(posts(queries, pivots, visited).join(queries, "r"), "asked")
    sizes = files.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    counts = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("query_blocks"))
    shape = written(sizes.join(counts, "pivot"), "shape")  # a row for each reference point
    part = lambda n: F.pmod(F.xxhash64("r"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = files.join(F.broadcast(shape), "pivot").select("pivot", part("blocks").alias("x"), every("query_blocks").alias("y"), "r", "id", "v", F.lit(False).alias("query"))
    right = asked.join(F.broadcast(shape), "pivot").select("pivot", every("blocks").alias("x"), part("query_blocks").alias("y"), "r", "id", "v", F.lit(True).alias("query"))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot = key[0]
        pdf = pdf.sort_values(["id", "r"])
        ask, own = pdf[pdf["query"]], pdf[~pdf["query"]]
        out: dict[str, list] = {"q": [], "r": [], "id": [], "score": []}
        if len(ask) and len(own):
            to = lambda frame: np.array([np.asarray(v, np.float64) for v in frame["v"]])
            x, y = to(own), to(ask)
            r, ids = own["r"].to_numpy(), own["id"].to_numpy()
            if pivot >= 0:
                p = points.value
                near_x, near_y = order(x, p, len(p)), order(y, p, len(p))
                rank_x, rank_y = (np.argsort(o, axis=1).astype(np.int16) for o in (near_x, near_y))
            for i, q in enumerate(ask["r"].to_numpy()):
                here = r != q
                if pivot >= 0:
                    visits = rank_y[i] < visited
                    # A vector is looked at in the file of the first of its reference points that the query visits.
                    mine = visits[near_x[:, :posted]]
                    here &= near_x[np.arange(len(x)), mine.argmax(axis=1)] == pivot
                at = np.flatnonzero(here)
                n = max(LEAST, k, int(np.ceil(share * len(at))))
                if pivot >= 0 and n < len(at):
                    foot = np.abs(rank_x[at] - rank_y[i]).sum(axis=1, dtype=np.int32)
                    at = at[foot <= max(np.partition(foot, n - 1)[n - 1], CLOSE * len(p) ** 2 / 3)]
                score = np.sqrt(((x[at] - y[i]) ** 2).sum(axis=1))
                best = np.argsort(score, kind="stable")[:k]  # rows are in order of keys
                out["q"] += [q] * len(best)
                out["r"] += r[at[best]].tolist()
                out["id"] += ids[at[best]].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame({c: np.array(v, np.float64 if c == "score" else np.int64) for c, v in out.items()})

    return left.union(right).groupBy("pivot", "x", "y").applyInPandas(meet, "q long, r long, id long, score double")


def nearest(vectors: DataFrame, asked: Column, k: int, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, visited: int = VISITED, posted: int = POSTED, share: float = SHARE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, key, score``: of each query row, the ``k`` nearest found among all other rows of ``vectors``.

    Queries are the rows of ``vectors`` for which ``asked`` holds.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = written(rows, "vectors").withColumn("r", F.monotonically_increasing_id())
    points = reference_points(rows, "id", "v", pivots, SEED)
    own, queries = rows.select("r", "id", "v"), rows.where("asked").select("r", "id", "v")
    found = written(_search(queries, own, points, k, visited, posted, share, block, query_block), "found")
    short = queries.join(found.groupBy(F.col("q").alias("r")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "r", "left_anti")
    short = written(short, "short")
    if short.limit(1).count():
        again = _search(short, own, points, k, len(points), len(points), 1.0, block, query_block)
        found = found.join(short.select(F.col("r").alias("q")), "q", "left_anti").select("q", "r", "id", "score").union(written(again, "again"))
    best = Window.partitionBy("q").orderBy("score", "id", "r")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("r").alias("q"), F.col("id").alias("query_id")), "q").select("query_id", "rank", F.col("id").alias(key), "score")
