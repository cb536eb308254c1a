"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, in order, and posted under each of the
first few. Vectors of one label meet in the inverted lists; those that share enough reference points are
candidates, and candidates are verified by their cosine in double precision. Equal vectors are one
class that meets the others once. Lists are cut into blocks, and blocks meet in pairs, so that
no list, however long, is one task's; a pair of vectors is looked at only in the list of the
smallest reference point that they share. A task returns numbers of links and a spanning forest of them, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those without a label, link with nothing; so do vectors of different lengths. Rows that repeat a key and vector
are linked like other equal vectors. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pivots import order, reference_points, usable
from graphloom.llm.support import components, written

LEAST_COSINE = 0.98
#: Reference points: about twice the root of the number of vectors, between these.
LEAST_PIVOTS, MOST_PIVOTS = 128, 4096
#: Lists that a vector stands in, and reference points that two must share.
POSTED, SHARED = 8, 2
BLOCK = 1024
SEED = 31


def pivot_count(n: int) -> int:
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * n**0.5)))


def _forest(link: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the rows of a symmetric link matrix just as all its links do."""
    label = np.arange(len(link))
    while True:
        low = np.where(link, label[None], len(label)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(names[i]), int(names[j])) for i, j in enumerate(label) if i != j]


def links(classes: DataFrame, pivots: np.ndarray, least: float = LEAST_COSINE, posted: int = POSTED, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``kind, a, b`` of ``c, label, v, size``: kind 0 edges of a spanning forest of the links; kind 1: ``b`` linked rows of class ``a``."""
    spark = classes.sparkSession
    points = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column(1).to_pylist()]
            out: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                x = np.array([vectors[i] for i in at])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                # Vectors of an uncommon length have no reference points; they all meet under one.
                near = order(x, points.value, posted) if size == points.value.shape[1] else np.full((len(at), 1), -size)
                for i, row in zip(at, near.tolist()):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["c", "near"])

    near = written(classes.select("c", "v").mapInArrow(describe, "c long, near array<int>"), "permutations")
    posts = near.join(classes, "c").select("c", "label", "size", "v", "near", F.explode("near").alias("pivot"))
    lists = near.join(classes.select("c", "label"), "c").select("label", F.explode("near").alias("pivot")).groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = written(lists.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "lists")
    posts = posts.join(lists, ["label", "pivot"]).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # A block meets itself and every other one: each pair of blocks is a group of its own.
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.select("label", "pivot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "c", "size", "v", "near")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, pivot, left, right = key
        pdf = pdf.sort_values("c", ignore_index=True)
        names, size, side = pdf["c"].to_numpy(), pdf["size"].to_numpy(), pdf["own"].to_numpy()
        x = np.array([np.asarray(v, np.float64) for v in pdf["v"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link = x @ x.T >= least
        np.fill_diagonal(link, False)
        if left != right:
            link &= side[:, None] != side[None]
        if pivot >= 0:
            ids, at = np.unique(np.concatenate(pdf["near"].to_numpy()), return_inverse=True)
            has = np.zeros((len(x), len(ids)), np.float32)
            has[np.repeat(np.arange(len(x)), [len(p) for p in pdf["near"]]), at] = 1
            link &= has @ has.T >= shared
            # Only here if no smaller reference point is shared.
            link &= has[:, ids < pivot] @ has[:, ids < pivot].T == 0
        n = link @ size
        edges = _forest(link, names)
        some = n > 0
        return pd.DataFrame(
            {
                "kind": np.concatenate([np.zeros(len(edges), int), np.ones(some.sum(), int)]),
                "a": np.concatenate([np.array([a for a, _ in edges], np.int64), names[some]]),
                "b": np.concatenate([np.array([b for _, b in edges], np.int64), n[some]]),
            }
        )

    return posts.groupBy("label", "pivot", "x", "y").applyInPandas(meet, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row."""
    rows = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.col("label").isNotNull() & F.col("k").isNotNull(), F.col("v")))
    rows = written(rows, "vectors")
    good = rows.where(F.col("v").isNotNull())
    # Equal vectors of a label are one class, named by its smallest key.
    classes = written(good.groupBy("label", "v").agg(F.min("k").alias("c"), F.count(F.lit(1)).alias("size")), "classes")
    n = classes.count()
    pivots = reference_points(classes, "c", "v", pivot_count(n), SEED)
    if len(pivots):
        pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    # Keys may name rows of several classes; a number of its own keeps classes apart.
    classes = written(classes.withColumn("name", F.col("c")).withColumn("c", F.monotonically_increasing_id()), "numbered")
    found = written(links(classes, pivots, least, block=block), "links")
    label_of = components(found.where("kind = 0").select("a", "b"))
    counts = found.where("kind = 1").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("other"))
    top = classes.select("c", "label", "v", "name", "size").join(label_of.withColumnRenamed("id", "c"), "c", "left").join(counts, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least_name = top.groupBy("component").agg(F.min("name").alias("component_id"))
    per_class = top.join(least_name, "component").select(F.col("label").alias("l"), F.col("v").alias("cv"), (F.coalesce("other", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.join(per_class, (F.col("label") == F.col("l")) & (F.col("v") == F.col("cv")), "left")
    component = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("k") == component).alias("kept"))
