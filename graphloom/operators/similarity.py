"""Best pairs of vectors, exactly, without forming all pairs.

Vectors are put in bounded *tiles*: by the nearest of a few pivot vectors, then by the
angle to that pivot, then by hash where a tile would still be too large. The triangle
inequality on angles bounds the best pair two tiles can hold, so most tile pairs are
never looked at. What is left is scored in tasks of two tiles each, and a task returns
no more rows than the report may have.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.vectors import as_double, norm
from graphloom.model import PropertyGraph
from graphloom.session import BROADCAST_ROWS, broadcast_if_small, cut

# Every pair of tiles is shuffled, so that tiles are large: rows, and numbers in their vectors.
TILE_ROWS = 16_384
TILE_VALUES = 1 << 20
# Rows whose scores a task holds at once.
SCORED_ROWS = 256
# Tile pairs of one task.
TASK_PAIRS = 4
MAX_PIVOTS = 512
FIRST_TILE_PAIRS = 64
# So many groups fit a tile that is shared.
PACKED = 8
SEAM_ROWS = 50
# Scores are compared at this many decimals, so that float noise orders no pairs.
SCORE_DECIMALS = 9
SLACK = 1e-6

_PAIR_SCHEMA = "grp string, id_a string, id_b string, similarity double"


def _unit_rows(vectors: DataFrame, limit: int) -> DataFrame:
    """Unit vectors; of exact copies in a group only those that can enter the report.

    All pairs of two given vectors score the same and are ranked by id, so no row past
    the first ``limit + 1`` copies can be in the first ``limit`` pairs.
    """
    length = norm(F.col("vec"))
    unit = vectors.withColumn("len", length).where("len > 0").select(
        F.coalesce("grp", F.lit("")).alias("grp"),
        "id",
        F.transform(as_double(F.col("vec")), lambda x: x / F.col("len")).alias("vec"),
    )
    copies = W.partitionBy("grp", "vec").orderBy("id")
    return unit.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= limit + 1).drop("copy")


def _tiled(rows: DataFrame, total: int, tile_rows: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with tile columns ``home, cell, ring, part`` and the angle to the pivot.

    Groups that fit a tile are packed together by hash; larger ones are split.
    """
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("grp_rows")))
    packs = max(1, math.ceil(total / tile_rows))
    pack = F.concat(F.lit("pack "), F.pmod(F.xxhash64("grp"), F.lit(packs)).cast("string"))
    small = F.col("grp_rows") <= tile_rows
    # Groups that nearly fill a tile are one each.
    homed = rows.join(broadcast_if_small(sizes), "grp").select(
        "grp", "id", "vec", F.when(F.col("grp_rows") * PACKED <= tile_rows, pack).otherwise(F.concat(F.lit("group "), "grp")).alias("home"),
        small.alias("packed"),
    )
    # Pivots cut every group that is split: more than its tiles would make smaller tiles, and far more pairs of them.
    largest = sizes.agg(F.max("grp_rows")).first()[0]
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, math.ceil(largest / tile_rows))).select("vec").collect()
    pivots = np.array([r["vec"] for r in picked])

    def nearest(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            cosines = np.stack(pdf["vec"].to_numpy()) @ pivots.T
            cell = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(pdf)), cell], -1.0, 1.0))
            yield pdf.assign(cell=np.where(pdf["packed"], -1, cell).astype("int32"), angle=angle)

    schema = "grp string, id string, vec array<double>, home string, packed boolean, cell int, angle double"
    placed = cut(homed.mapInPandas(nearest, schema))

    cuts = placed.where("not packed").groupBy("home", "cell").agg(
        F.count("*").alias("n"), F.percentile_approx("angle", [i / 64 for i in range(1, 64)], 1000).alias("at")
    )
    # As many rings as tiles are needed, up to 64; equal shares of the cell by angle.
    rings = F.least(F.ceil(F.col("n") / tile_rows), F.lit(64))
    ring = F.floor(F.size(F.filter("at", lambda c: c < F.col("angle"))) * rings / 64).cast("int")
    ringed = placed.join(broadcast_if_small(cut(cuts)), ["home", "cell"], "left").withColumn(
        "ring", F.coalesce(ring, F.lit(0))
    )
    counts = ringed.where("not packed").groupBy("home", "cell", "ring").agg(F.count("*").alias("ring_rows"))
    parts = F.greatest(F.ceil(F.col("ring_rows") / tile_rows), F.lit(1))
    out = ringed.join(broadcast_if_small(cut(counts)), ["home", "cell", "ring"], "left").select(
        "grp", "id", "vec", "home", "cell", "ring", "angle",
        F.coalesce(F.pmod(F.xxhash64("id"), parts), F.lit(0)).cast("int").alias("part"),
    )
    return cut(out), pivots


def _tile_pairs(rows: DataFrame, pivots: np.ndarray, closest: bool, threshold: float) -> DataFrame:
    """Tile pairs that may hold a pair within the threshold, and the best angle they allow."""
    spark = rows.sparkSession
    packed = F.col("cell") == -1
    tiles = cut(
        rows.groupBy("home", "cell", "ring", "part").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    ).withColumn("lo", F.when(packed, 0.0).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(packed, math.pi).otherwise(F.col("hi"))
    )
    # At most MAX_PIVOTS squared rows, whatever the data.
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    np.fill_diagonal(between, 0.0)
    a, b = np.meshgrid(np.arange(len(pivots)), np.arange(len(pivots)), indexing="ij")
    near = pd.DataFrame({"ca": a.ravel(), "cb": b.ravel(), "apart": between.ravel()})
    near = pd.concat([near, pd.DataFrame({"ca": [-1], "cb": [-1], "apart": [0.0]})])
    cells = F.broadcast(spark.createDataFrame(near, "ca int, cb int, apart double"))

    def side(letter: str) -> DataFrame:
        return tiles.select(
            "home",
            *[F.col(c).alias(f"{s}{letter}") for c, s in
              (("cell", "c"), ("ring", "r"), ("part", "p"), ("lo", "lo"), ("hi", "hi"))],
        )

    best = "greatest(0, apart - hia - hib, loa - apart - hib, lob - apart - hia)" if closest else "least(pi(), apart + hia + hib)"
    bound = math.acos(max(-1.0, min(1.0, 2 * threshold - 1)))
    wanted = F.col("best") <= bound + SLACK if closest else F.col("best") >= bound - SLACK
    ordered = F.struct("ca", "ra", "pa") <= F.struct("cb", "rb", "pb")
    return (
        side("a").join(cells, "ca").join(side("b"), ["home", "cb"]).where(ordered)
        .withColumn("best", F.expr(best)).where(wanted)
        .withColumn("diagonal", F.struct("ca", "ra", "pa") == F.struct("cb", "rb", "pb"))
        .withColumn("pid", F.concat_ws("|", "home", "ca", "ra", "pa", "cb", "rb", "pb"))
        .select("pid", "home", "ca", "ra", "pa", "cb", "rb", "pb", "best", "diagonal")
    )


def _score(rows: DataFrame, pairs: DataFrame, limit: int, threshold: float, closest: bool, last: float | None = None) -> DataFrame:
    """The best ``limit`` pairs of every tile pair; with ``last``, only those at least as good as that score."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs.count() / TASK_PAIRS))

    def side(letter: str) -> DataFrame:
        keys = pairs.select(
            "pid", "diagonal", "home", F.col(f"c{letter}").alias("cell"),
            F.col(f"r{letter}").alias("ring"), F.col(f"p{letter}").alias("part"),
        )
        columns = ["pid", "diagonal", "grp", "id", "vec"]
        # Fresh column identities: both sides of the cogroup come from the same frame.
        return rows.join(keys, ["home", "cell", "ring", "part"]).select(*columns).toDF(*columns).repartition(tasks, "pid")

    def best_of_group(grp: str, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame | None:
        a, b = a.sort_values("id"), b.sort_values("id")
        diagonal = a["diagonal"].iloc[0]
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        left, right = np.stack(a["vec"].to_numpy()), np.stack(b["vec"].to_numpy()).T
        bound, best = last, None
        for start in range(0, len(left), SCORED_ROWS):
            skipped = start if diagonal else 0
            cosines = left[start : start + SCORED_ROWS] @ right[:, skipped:]
            # A first look at unrounded scores; those it lets pass are rounded and compared.
            if closest:
                good = cosines >= 2 * (threshold if bound is None else max(threshold, bound)) - 1 - SLACK
            else:
                good = cosines <= 2 * (threshold if bound is None else min(threshold, bound)) - 1 + SLACK
            i, j = np.nonzero(good)
            if diagonal:
                i, j = i[j > i], j[j > i]
            scores = np.round((1 + cosines[i, j]) / 2, SCORE_DECIMALS)
            inside = scores >= threshold if closest else scores < threshold
            i, j, scores = i[inside], j[inside], scores[inside]
            if not len(i):
                continue
            rank = -scores if closest else scores
            if len(rank) > limit:
                keep = rank <= np.partition(rank, limit - 1)[limit - 1]
                i, j, rank = i[keep], j[keep], rank[keep]
            one, two = ids_a[i + start], ids_b[j + skipped]
            swap = one > two
            found = pd.DataFrame({"grp": grp, "id_a": np.where(swap, two, one), "id_b": np.where(swap, one, two), "similarity": np.abs(rank), "rank": rank})
            best = (found if best is None else pd.concat([best, found])).sort_values(["rank", "id_a", "id_b"]).head(limit)
            if len(best) == limit:
                worst = float(best["similarity"].iloc[-1])
                bound = worst if bound is None else max(bound, worst) if closest else min(bound, worst)
        return None if best is None else best.drop(columns="rank")

    def best_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        others = dict(tuple(right.groupby("grp")))
        out = [best_of_group(grp, a, others[grp]) for grp, a in left.groupby("grp") if grp in others]
        out = [found for found in out if found is not None]
        if not out:
            return pd.DataFrame(columns=["grp", "id_a", "id_b", "similarity"], dtype=object)
        return pd.concat(out)

    return side("a").groupBy("pid").cogroup(side("b").groupBy("pid")).applyInPandas(best_of, _PAIR_SCHEMA)


def best_pairs(
    vectors: DataFrame, limit: int, threshold: float, closest: bool = True, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """The ``limit`` best pairs ``(grp, id_a, id_b, similarity)`` inside each other's group.

    ``vectors`` has ``grp, id, vec``. Closest pairs score at least ``threshold``, farthest
    ones less than it.
    """
    rows = cut(_unit_rows(vectors, limit))
    total = rows.count()
    order = [F.desc("similarity") if closest else F.asc("similarity"), "grp", "id_a", "id_b"]
    if total < 2:
        return rows.sparkSession.createDataFrame([], _PAIR_SCHEMA)
    tile_rows = max(1, min(tile_rows, TILE_VALUES // len(rows.select("vec").first()[0])))
    if total <= tile_rows:
        tiled = rows.selectExpr("grp", "id", "vec", "'all' as home", "-1 as cell", "0 as ring", "0 as part")
        alone = rows.sparkSession.range(1).selectExpr(
            "'all' as pid", "'all' as home", "-1 as ca", "0 as ra", "0 as pa", "-1 as cb", "0 as rb", "0 as pb",
            "true as diagonal",
        )
        return _score(tiled, alone, limit, threshold, closest).orderBy(*order).limit(limit)
    tiled, pivots = _tiled(rows, total, tile_rows)
    pairs = cut(_tile_pairs(tiled, pivots, closest, threshold))
    promising = [F.asc("best") if closest else F.desc("best"), "pid"]
    first = cut(pairs.orderBy(*promising).limit(FIRST_TILE_PAIRS))
    found = cut(_score(tiled, first, limit, threshold, closest).orderBy(*order).limit(limit))
    rest = pairs.join(first.select("pid"), "pid", "left_anti")
    last = None
    if found.count() == limit:
        # The report is full: other tile pairs must be able to match its last row.
        last = found.agg(F.min("similarity") if closest else F.max("similarity")).first()[0]
        bound = math.acos(max(-1.0, min(1.0, 2 * last - 1)))
        rest = rest.where(F.col("best") <= bound + SLACK if closest else F.col("best") >= bound - SLACK)
    rest = cut(rest)
    if rest.isEmpty():
        return found
    more = _score(tiled, rest, limit, threshold, closest, last)
    return cut(found.unionByName(more).orderBy(*order).limit(limit))


def find_duplicates(graph: PropertyGraph, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    """Pairs of functions with similar vectors, best first."""
    functions = graph.labelled("Function").where("embedding is not null")
    vectors = functions.select(F.lit("").alias("grp"), "id", F.col("embedding").alias("vec"))
    top = best_pairs(vectors, limit, threshold)
    return _named(functions, top, limit).select(
        F.col("name_a").alias("function_a"), "id_a", F.col("name_b").alias("function_b"), "id_b", "similarity"
    )


def _hinted(keys: DataFrame, limit: int) -> DataFrame:
    """Keys of report rows, at most two a row, broadcast where the report is small."""
    return F.broadcast(keys) if 2 * limit <= BROADCAST_ROWS else keys


def _named(functions: DataFrame, top: DataFrame, limit: int) -> DataFrame:
    """Names for the rows of a report."""
    names = functions.select("id", "name")
    ids = top.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    few = names.join(_hinted(ids, limit), "id", "left_semi")
    return (
        top.join(few.select(F.col("id").alias("id_a"), F.col("name").alias("name_a")), "id_a")
        .join(few.select(F.col("id").alias("id_b"), F.col("name").alias("name_b")), "id_b")
    )


def semantic_seams(graph: PropertyGraph, threshold: float = 0.5, distinct: bool = False) -> DataFrame:
    """Least similar pairs of functions that share a file or class.

    A pair linked to its container in several ways is listed once per combination,
    unless ``distinct`` is asked for.
    """
    functions = graph.labelled("Function").where("embedding is not null").select("id", "name", "embedding")
    containers = graph.labelled("File", "Class").select(
        F.col("id").alias("grp"), F.coalesce("name", "file", "id").alias("container")
    )
    links = graph.of_type("DEFINES", "DEFINED_IN")
    either = links.select(F.col("src").alias("grp"), F.col("dst").alias("id")).unionByName(
        links.where("src <> dst").select(F.col("dst").alias("grp"), F.col("src").alias("id"))
    )
    held = (
        either.join(containers.select("grp"), "grp", "left_semi")
        .groupBy("grp", "id")
        .agg(F.count("*").alias("ways"))
        .join(functions, "id")
    )
    top = best_pairs(held.select("grp", "id", F.col("embedding").alias("vec")), SEAM_ROWS, threshold, closest=False)
    named = _named(functions, top, SEAM_ROWS).join(containers, "grp")
    if not distinct:
        ways = held.select("grp", "id", "ways")
        keys = top.select("grp", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
        few = ways.join(_hinted(keys, SEAM_ROWS), ["grp", "id"], "left_semi")
        named = (
            named.join(few.select("grp", F.col("id").alias("id_a"), F.col("ways").alias("wa")), ["grp", "id_a"])
            .join(few.select("grp", F.col("id").alias("id_b"), F.col("ways").alias("wb")), ["grp", "id_b"])
            .withColumn("again", F.explode(F.sequence(F.lit(1), (F.col("wa") * F.col("wb")).cast("int"))))
        )
    return (
        named.orderBy("similarity", "grp", "id_a", "id_b")
        .limit(SEAM_ROWS)
        .select("container", F.col("name_a").alias("method_a"), F.col("name_b").alias("method_b"), "similarity")
    )
