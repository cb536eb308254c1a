"""Lloyd's k-means with cosine distance, on partitioned data.

Centroids are plain means. Ties go to the lowest cluster, an empty cluster keeps its
centroid, and the loop stops when no row moves, or after ``max_iterations`` where that is not None. Seeds double every round: a round draws as many as
there are, without replacement, each with a chance that grows with the squared distance to
the seeds so far. Draws hash the row id, so that the result depends neither on partitioning nor
on where the work is done: in one task, with centroids held by every task, or in blocks.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.vectors import as_double
from graphloom.session import broadcast_if_small, cut, cut_afresh, cut_in_place

MAX_ITERATIONS = 50
# Up to this many centroids are held by every task; beyond it they are joined in chunks.
HELD_CENTROIDS = 2048
# Task sums are added up in this many shares first.
SUM_SHARES = 256
# Groups up to this size are clustered inside one task each, if their vectors hold no more numbers than that.
GROUP_ROWS = 65_536
GROUP_VALUES = 1 << 22
# Rows whose distances to all centroids a task holds at once.
DISTANCE_ROWS = 1024
# Of larger groups, rows in a block, and numbers of a block or of the centroids that meet it.
BLOCK_ROWS = 32_768
BLOCK_VALUES = 1 << 22
# Distances that differ by less may be in either order, by rounding.
ROUNDING = 1e-12


def cosine_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """One minus cosine for every row and centroid; 1 where a vector has no length."""
    lengths = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(centroids, axis=1)[None, :]
    dots = rows @ centroids.T
    return 1.0 - np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row, the first of equally near ones, and the distance to it."""
    at, least = np.zeros(len(rows), dtype=int), np.zeros(len(rows))
    for start in range(0, len(rows), DISTANCE_ROWS):
        distances = cosine_distances(rows[start : start + DISTANCE_ROWS], centroids)
        best = distances.argmin(axis=1)
        at[start : start + DISTANCE_ROWS], least[start : start + DISTANCE_ROWS] = best, distances[np.arange(len(best)), best]
    return at, least


def _own_distance(rows: np.ndarray, centroids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The distance of every row to the centroid it is with."""
    out = np.empty(len(rows))
    for start in range(0, len(rows), DISTANCE_ROWS):
        part = slice(start, start + DISTANCE_ROWS)
        a, b = rows[part], centroids[to[part]]
        lengths = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        dots = np.einsum("ij,ij->i", a, b)
        out[part] = 1.0 - np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)
    return out


def _nearest_again(rows: np.ndarray, centroids: np.ndarray, moved: np.ndarray, to: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_nearest` after some centroids ``moved``; ``to`` and ``least`` are what it gave before they did.

    Centroids that stay are as far as they were, so a row that is no farther from its own one than before meets only those that moved.
    A row whose own centroid went away meets all of them.
    """
    at = np.flatnonzero(moved)
    if not len(at):
        return to, least
    if 2 * len(at) > len(centroids):
        return _nearest(rows, centroids)
    away = np.flatnonzero(moved[to])
    away = away[_own_distance(rows[away], centroids, to[away]) > least[away] - ROUNDING]
    all_of = np.zeros(len(rows), dtype=bool)
    all_of[away] = True
    to, least = to.copy(), least.copy()
    some = np.flatnonzero(~all_of)
    stays = ~moved[to[some]]
    found, distance = _nearest(rows[some], centroids[at])
    found = at[found]
    # Its own centroid, where it stays, is left only for a nearer one, or for an equally near one that comes first.
    better = ~stays | (distance < least[some]) | ((distance == least[some]) & (found < to[some]))
    to[some[better]], least[some[better]] = found[better], distance[better]
    to[away], least[away] = _nearest(rows[away], centroids)
    return to, least


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _uniform(seed: int, salt: int, key: str = "id") -> Column:
    """A number in (0, 1] per id, the same in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)), 11)
    return (bits.cast("double") + 1.0) / float(1 << 53)


def default_k(n: int) -> int:
    """A fifth of the rows, at least 2, at most half of them."""
    return min(max(n // 5, 2), n // 2)


def domain_k(files: int) -> int:
    """Number of top-level domains for a number of files."""
    if files == 0:
        return 0
    return min(max(math.isqrt(files // 5), 5), 50)


def domain_count(files: Column) -> Column:
    """:func:`domain_k` of a column of file counts."""
    k = F.least(F.greatest(F.floor(F.sqrt(F.floor(files / 5))), F.lit(5)), F.lit(50))
    return F.when(files == 0, 0).otherwise(k).cast("bigint")


def _draw_key(distance: Column, seed: int, draw: int) -> Column:
    """The least of -ln(u)/w is drawn with probability proportional to w, the squared distance."""
    return F.when(distance > 0, -F.log(_uniform(seed, draw)) / F.pow(distance, F.lit(2))).otherwise(F.lit(float("inf")))


def _with_distance(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(dist=cosine_distances(_stack(pdf["vec"]), centroids).min(axis=1))

    return points.select("id", "vec").mapInPandas(run, "id string, vec array<double>, dist double")


def seed_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """``k`` seeds for a ``k`` that tasks can hold; one pass over the points for each doubling."""
    first = points.orderBy(_uniform(seed, 0), "id").limit(1).select("vec").first()
    chosen = [np.array(first["vec"], dtype="float64")]
    draw = 0
    while len(chosen) < k:
        draw += 1
        fresh = _with_distance(points, np.stack(chosen)).orderBy(_draw_key(F.col("dist"), seed, draw), "id").limit(min(len(chosen), k - len(chosen)))
        chosen += [np.array(row["vec"], dtype="float64") for row in fresh.select("vec").collect()]
    return np.stack(chosen)


def _pass(points: DataFrame, now: np.ndarray) -> np.ndarray:
    """New means of the rows nearest to each centroid.

    Each task adds up its rows per cluster; what is gathered is k rows per dimension.
    """

    def run(batches):
        sums, counts = np.zeros_like(now), np.zeros(len(now))
        for pdf in batches:
            if len(pdf):
                rows = _stack(pdf["vec"])
                to = cosine_distances(rows, now).argmin(axis=1)
                np.add.at(sums, to, rows)
                counts += np.bincount(to, minlength=len(now))
        yield pd.DataFrame({"cluster": np.arange(len(now)), "n": counts, "total": list(sums)})

    partial = points.select("vec").mapInPandas(run, "cluster int, n double, total array<double>")
    zeros = F.array_repeat(F.lit(0.0), now.shape[1])
    # Task sums are folded in a fixed order, so the means are the same in every run; in two
    # rounds, so that no fold grows with the number of tasks.
    folded = F.aggregate(
        F.array_sort(F.collect_list("total")), zeros, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y)
    )
    sums = [F.sum("n").alias("n"), folded.alias("total")]
    share = F.pmod(F.spark_partition_id(), F.lit(SUM_SHARES)).alias("share")
    first = partial.select("*", share).groupBy("cluster", "share").agg(*sums)
    means = now.copy()
    for row in first.groupBy("cluster").agg(*sums).where("n > 0").collect():
        means[row["cluster"]] = np.array(row["total"]) / row["n"]
    return means


def _rounds(max_iterations: int | None):
    """Numbers of rounds: up to the bound, or without an end."""
    return count() if max_iterations is None else range(max_iterations)


def kmeans(points: DataFrame, k: int, seed: int = 42, max_iterations: int | None = MAX_ITERATIONS, held: int = HELD_CENTROIDS) -> DataFrame:
    """``(id, cluster)`` for ``points(id, vec)``; centroids that no task can hold are joined in chunks."""
    points = cut(points.select("id", as_double(F.col("vec")).alias("vec")))
    n = points.count()
    if k < 1 or not n:
        return points.sparkSession.createDataFrame([], "id string, cluster int")
    k = min(k, n)
    if k > held:
        one = points.sparkSession.createDataFrame([("", n, k)], "grp string, n bigint, k bigint")
        return _large_groups(points.withColumn("grp", F.lit("")), one, seed, max_iterations, held).select("id", "cluster")
    now = before = seed_centroids(points, k, seed)
    seen = set()
    for _ in _rounds(max_iterations):
        means = _pass(points, now)
        # Means that stay are means of rows that stay. Means of an earlier round come back where distances differ by rounding only.
        if np.array_equal(means, now) or (mark := hash(means.tobytes())) in seen:
            before = now
            break
        seen.add(mark)
        before, now = now, means

    def run(batches):
        for pdf in batches:
            if len(pdf):
                # The last assignment made is the one under the centroids before the final means.
                near = cosine_distances(_stack(pdf["vec"]), before).argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "cluster": near.astype("int32")})

    return points.mapInPandas(run, "id string, cluster int")


def _local(ids: np.ndarray, vectors: np.ndarray, draws: np.ndarray, k: int, max_iterations: int | None) -> np.ndarray:
    """Clusters of one group in one task; ``draws`` has each row's number for every round."""
    at = [int(np.lexsort((ids, draws[:, 0]))[0])]
    nearest = _nearest(vectors, vectors[at])[1]
    draw = 0
    while len(at) < k:
        draw += 1
        with np.errstate(divide="ignore"):
            key = np.where(nearest > 0, -np.log(draws[:, draw]) / np.power(nearest, 2), np.inf)
        fresh = np.lexsort((ids, key))[: min(len(at), k - len(at))]
        at += fresh.tolist()
        nearest = np.minimum(nearest, _nearest(vectors, vectors[fresh])[1])
    centroids, to = vectors[at].copy(), np.zeros(len(vectors), dtype=int)
    least, moved = np.zeros(len(vectors)), np.ones(len(centroids), dtype=bool)
    seen = set()
    for _ in _rounds(max_iterations):
        near, least = _nearest_again(vectors, centroids, moved, to, least)
        if (near == to).all() or (mark := hash(near.tobytes())) in seen:
            break
        seen.add(mark)
        to = near
        sums, counts = np.zeros_like(centroids), np.bincount(to, minlength=k)
        np.add.at(sums, to, vectors)
        filled = counts > 0
        means = centroids.copy()
        means[filled] = sums[filled] / counts[filled, None]
        moved, centroids = (means != centroids).any(axis=1), means
    return to


def _nearest_in_chunks(points: DataFrame, centroids: DataFrame, shape: DataFrame) -> DataFrame:
    """``(grp, id, cluster, dist)`` when centroids are too many for a task.

    Points and centroids of a group meet block by block; ``shape(grp, blocks, chunks)``
    says in how many, so that a block is bounded. Each point keeps its best per chunk,
    then its best of all.
    """
    left = points.join(shape, "grp").select(
        "grp", "id", "vec",
        F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )
    right = centroids.join(shape, "grp").select(
        "grp", "cluster", "vec",
        F.pmod(F.xxhash64("cluster"), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b.cast("bigint"))).alias("block"),
    )

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["grp", "id", "cluster", "dist"], dtype=object)
        b = b.sort_values("cluster")
        at, least = _nearest(_stack(a["vec"]), _stack(b["vec"]))
        found = {"grp": a["grp"], "id": a["id"], "cluster": b["cluster"].to_numpy()[at], "dist": least}
        return pd.DataFrame(found)

    keys = ["grp", "block", "chunk"]
    # Fresh column identities: centroids may come from the points themselves.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    per_chunk = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best, "grp string, id string, cluster bigint, dist double"
    )
    return per_chunk.groupBy("grp", "id").agg(F.min(F.struct("dist", "cluster")).alias("best")).select(
        "grp", "id", F.col("best.cluster").alias("cluster"), F.col("best.dist").alias("dist")
    )


def nearest_means(points: DataFrame, means: DataFrame, chunk_rows: int = HELD_CENTROIDS) -> DataFrame:
    """``(grp, id, cluster, dist)``: the nearest of the ``means(grp, cluster, vec)`` of its group for each of ``points(grp, id, vec)``, in bounded blocks."""
    blocks = points.groupBy("grp").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("blocks"))
    chunks = means.groupBy("grp").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    return _nearest_in_chunks(points, means, broadcast_if_small(cut(blocks.join(chunks, "grp"))))


def _means(points: DataFrame) -> DataFrame:
    """``(grp, cluster, mean)`` of ``points(grp, cluster, id, vec)``: rows are added up as they stream by, in the order of their ids."""

    def run(batches):
        key, total, n = None, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            new = (pdf["grp"] != pdf["grp"].shift()) | (pdf["cluster"] != pdf["cluster"].shift())
            at, rows, first = new.cumsum().to_numpy() - 1, _stack(pdf["vec"]), pdf[new]
            keys = list(zip(first["grp"], first["cluster"]))
            sums, counts = np.zeros((len(keys), rows.shape[1])), np.zeros(len(keys))
            done = []
            if keys[0] == key:
                sums[0], counts[0] = total, n
            elif key is not None:
                done.append((*key, total / n))
            np.add.at(sums, at, rows)
            counts += np.bincount(at, minlength=len(keys))
            done += [(*k, s / c) for k, s, c in zip(keys[:-1], sums, counts)]
            key, total, n = keys[-1], sums[-1], counts[-1]
            yield pd.DataFrame(done, columns=["grp", "cluster", "mean"])
        if key is not None:
            yield pd.DataFrame([(*key, total / n)], columns=["grp", "cluster", "mean"])

    dealt = points.select("grp", "cluster", "id", "vec").repartition("grp", "cluster").sortWithinPartitions("grp", "cluster", "id")
    return dealt.mapInPandas(run, "grp string, cluster bigint, mean array<double>")


def ranked(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Exact ``place`` (from 0) of every row inside its group, in no single task.

    A range sort numbers rows inside partitions; offsets are added from one count per
    partition and group.
    """
    ordered = cut(rows.orderBy(by, *order).withColumn("at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    marked = ordered.select("*", part.alias("part"), inside.alias("inside"))
    spans = marked.groupBy(by, "part").agg(F.count("*").alias("n"), F.min("inside").alias("start"))
    before = W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.select(by, "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (
        marked.join(broadcast_if_small(cut(offsets)), [by, "part"])
        .withColumn("place", F.col("inside") - F.col("start") + F.col("offset"))
        .drop("at", "part", "inside", "start", "offset")
    )


def _beside(points: DataFrame, state: DataFrame, centers: DataFrame, shape: DataFrame, parts: int, work, out: str) -> DataFrame:
    """``work(points, state, centers)`` of every block and chunk of a group.

    ``points(grp, block, chunk, id, vec)`` lie in ``parts`` by block and chunk and stay there. What comes to them is ``state(grp, block, id, cluster, dist)``,
    a few numbers a row, and the ``centers(grp, cluster, vec, moved)`` of their chunk, once for each block.
    """
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sides = shape.select("grp", "blocks", "chunks", F.col("chunks").alias("of"))
    rows = state.join(sides, "grp").select(
        "grp", "block", each(F.col("chunks")).alias("chunk"), "id", "cluster", "dist", F.lit(None).cast("array<double>").alias("vec"), F.lit(False).alias("moved"), "of"
    )
    means = centers.join(sides, "grp").select(
        "grp", each(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("cluster"), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(None).cast("string").alias("id"), "cluster", F.lit(None).cast("double").alias("dist"), "vec", "moved", "of",
    )
    keys = ["grp", "block", "chunk"]
    right = rows.unionByName(means).repartition(parts, *keys)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine = b["id"].notna()
        a, now, near = a.sort_values("id"), b[mine].sort_values("id"), b[~mine].sort_values("cluster")
        if not len(a) or not len(near):
            return pd.DataFrame(columns=[c.split()[0] for c in out.split(", ")], dtype=object)
        return work(a.reset_index(drop=True), now.reset_index(drop=True), near.reset_index(drop=True))

    # Fresh column identities: centers may come from the points themselves.
    right = right.toDF(*right.columns)
    return points.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, out)


def _seeded(a: pd.DataFrame, now: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """The distance of rows to the nearest seed, after ``near`` came to the seeds there were."""
    least = np.minimum(now["dist"].to_numpy("float64"), _nearest(_stack(a["vec"]), _stack(near["vec"]))[1])
    return pd.DataFrame({"grp": a["grp"], "block": a["block"], "id": a["id"], "cluster": now["cluster"], "dist": least})


def _assigned(a: pd.DataFrame, now: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """The nearest centroid of rows, that before (``old``) and the distance."""
    rows, centroids, clusters = _stack(a["vec"]), _stack(near["vec"]), near["cluster"].to_numpy("int64")
    old = now["cluster"].to_numpy("int64")
    if near["of"].iloc[0] == 1:
        to, least = _nearest_again(rows, centroids, near["moved"].to_numpy(bool), np.searchsorted(clusters, old), now["dist"].to_numpy("float64"))
    else:
        to, least = _nearest(rows, centroids)
    return pd.DataFrame({"grp": a["grp"], "block": a["block"], "id": a["id"], "cluster": clusters[to], "dist": least, "old": old})


def _large_groups(points: DataFrame, sizes: DataFrame, seed: int, max_iterations: int | None, chunk_rows: int | None) -> DataFrame:
    """Clusters for groups too large for one task, all of them at once; ``chunk_rows`` bounds what a task holds, by default the numbers of a vector do."""
    points = cut(points)
    # One row per group too large for a task: at most the rows over the size of a task.
    ks = broadcast_if_small(cut(sizes.select("grp", "n", "k")))
    some = points.select(F.size("vec")).first()
    held = chunk_rows or max(1, BLOCK_VALUES // max(1, some[0]))
    shape = broadcast_if_small(cut(ks.select(
        "grp", F.ceil(F.col("n") / min(held, BLOCK_ROWS)).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("k") / held), F.lit(1)).cast("int").alias("chunks")
    )))
    parts = max(points.sparkSession.sparkContext.defaultParallelism, shape.agg(F.sum(F.col("blocks") * F.col("chunks"))).first()[0])
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    dealt = points.join(shape, "grp").select("grp", block, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "vec")
    placed = cut_in_place(dealt.repartition(parts, "grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk", "id"))

    rounds = math.ceil(math.log2(ks.agg(F.max("k")).first()[0]))
    first = points.withColumn("u", _uniform(seed, 0)).groupBy("grp").agg(F.min(F.struct("u", "id")).alias("m"))
    picked = first.select("grp", F.col("m.id").alias("id"), F.lit(0).cast("bigint").alias("cluster"))
    new = cut(picked.join(points, ["grp", "id"]).select("grp", "cluster", "vec"))
    single, of_seeds = shape.select("grp", "blocks", "chunks"), "grp string, block int, id string, cluster bigint, dist double"
    near = placed.where("chunk = 0").select("grp", "block", "id", F.lit(-1).cast("bigint").alias("cluster"), F.lit(float("inf")).alias("dist"))
    seeds = new
    for r in range(rounds + 1):
        if r:
            have = 2 ** (r - 1)
            drawn = ranked(near.select("grp", "id", _draw_key(F.col("dist"), seed, r).alias("key")), "grp", [F.col("key"), F.col("id")])
            fresh = (
                drawn.join(ks.select("grp", "k"), "grp")
                .where(F.col("place") < F.least(F.lit(have), F.col("k") - have))
                .select("grp", "id", (F.col("place") + have).alias("cluster"))
            )
            new = cut_afresh(fresh.join(points, ["grp", "id"]).select("grp", "cluster", "vec"))
            if new.isEmpty():
                break
            seeds = seeds.unionByName(new)
        if r == rounds:
            break
        closer = _beside(placed, near, new.withColumn("moved", F.lit(True)), single, parts, _seeded, of_seeds)
        # Groups that have their seeds already get none, and rows of blocks whose chunk got none keep what they have.
        least = closer.unionByName(near).groupBy("grp", "block", "id").agg(F.min("dist").alias("dist"))
        near = cut_afresh(least.select("grp", "block", "id", F.lit(-1).cast("bigint").alias("cluster"), "dist"))
    centroids = cut_afresh(seeds.withColumn("moved", F.lit(True)))
    to = near.select("grp", "block", "id", F.lit(0).cast("bigint").alias("cluster"), "dist")
    several = shape.where("chunks > 1").limit(1).count() > 0
    seen = set()
    for turn in _rounds(max_iterations):
        found = _beside(placed, to, centroids, shape, parts, _assigned, f"{of_seeds}, old bigint")
        if several:
            best = found.groupBy("grp", "block", "id").agg(F.min(F.struct("dist", "cluster")).alias("best"), F.first("old").alias("old"))
            found = best.select("grp", "block", "id", "best.cluster", "best.dist", "old")
        to = cut_afresh(found)
        moved = to.where("cluster <> old")
        still = moved.isEmpty()
        if not still and max_iterations is None:
            # Clusters of an earlier round come back where distances differ by rounding only.
            mark = to.agg(F.sum(F.xxhash64("grp", "id", "cluster").cast("decimal(38,0)"))).first()[0]
            still = mark in seen
            seen.add(mark)
        if still:
            break
        # Of clusters that have the rows they had, the means stay. In the first round no mean is known.
        rows = to.select("grp", "block", "id", "cluster")
        if turn:
            touched = moved.select("grp", "cluster").unionByName(moved.select("grp", F.col("old").alias("cluster"))).distinct()
            rows = rows.join(broadcast_if_small(cut(touched)), ["grp", "cluster"], "left_semi")
        rows = rows.select("grp", "block", F.lit(0).alias("chunk"), "id", "cluster").repartition(parts, "grp", "block", "chunk")
        means = _means(placed.join(rows.hint("merge"), ["grp", "block", "chunk", "id"]))
        centroids = cut_afresh(
            centroids.select("grp", "cluster", "vec").join(means, ["grp", "cluster"], "left").select(
                "grp", "cluster", F.coalesce("mean", "vec").alias("vec"), (~F.coalesce(F.col("mean") == F.col("vec"), F.lit(True))).alias("moved")
            )
        )
        to = to.select("grp", "block", "id", "cluster", "dist")
    return to.select("grp", "id", F.col("cluster").cast("int").alias("cluster"))


def cluster_groups(
    points: DataFrame,
    seed: int = 42,
    max_iterations: int | None = MAX_ITERATIONS,
    group_rows: int = GROUP_ROWS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """``(grp, id, cluster)``: every group split on its own into a fifth as many clusters.

    Groups of up to three rows stay whole. Groups that fit a task are clustered in one;
    larger ones by the partitioned loop.
    """
    points = cut(points.select("grp", "id", as_double(F.col("vec")).alias("vec")))
    some = points.select(F.size("vec")).first()
    group_rows = max(1, min(group_rows, GROUP_VALUES // max(1, some[0] if some else 1)))
    n = F.col("n")
    k = F.least(F.greatest(F.floor(n / 5), F.lit(2)), F.floor(n / 2))
    sizes = cut(points.groupBy("grp").agg(F.count("*").alias("n")).withColumn("k", k.cast("bigint")))
    # A number for the first seed, and one for each doubling up to the clusters of the largest group.
    draws = F.array(*(_uniform(seed, i) for i in range(1 + math.ceil(math.log2(max(2, default_k(max(4, group_rows))))))))
    small = points.join(broadcast_if_small(sizes.where((n <= group_rows) | (n <= 3))), "grp", "left_semi").withColumn("draws", draws)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        to = np.zeros(len(pdf), dtype="int32")
        if len(pdf) > 3:
            to = _local(pdf["id"].to_numpy(str), _stack(pdf["vec"]), _stack(pdf["draws"]), default_k(len(pdf)), max_iterations).astype("int32")
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "cluster": to})

    parts = [small.groupBy("grp").applyInPandas(run, "grp string, id string, cluster int")]
    large = sizes.where((n > group_rows) & (n > 3))
    if not large.isEmpty():
        rows = points.join(broadcast_if_small(large), "grp", "left_semi")
        parts.append(_large_groups(rows, large, seed, max_iterations, chunk_rows))
    return reduce(DataFrame.unionByName, parts)
