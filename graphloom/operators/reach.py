"""Reachability over one-step relations.

A *step* frame has columns ``at`` and ``to``: standing on ``at`` one may move to ``to``.
Only the set of reached nodes is kept, never the paths, so each hop is at most one row
per node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.session import BROADCAST_ROWS, cut

# Bounded searches up to this depth stay one lazy plan.
LAZY_HOPS = 2


def steps(graph: PropertyGraph, types: tuple[str, ...], reverse: bool = False) -> DataFrame:
    at, to = ("dst", "src") if reverse else ("src", "dst")
    return graph.of_type(*types).select(F.col(at).alias("at"), F.col(to).alias("to"))


def _advance(frontier: DataFrame, step: DataFrame, small: bool) -> DataFrame:
    keys = F.broadcast(frontier) if small else frontier
    return (
        step.join(keys.select(F.col("id").alias("at")), "at", "left_semi")
        .select(F.col("to").alias("id"))
        .distinct()
    )


def reach(step: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(id, hops)`` of every node one or more steps away, at its least distance.

    Seeds are at distance 0 and are not listed, save when ``reach_again`` is what the
    caller wants (see :func:`reach_again`).
    """
    return distances(step, seeds, max_hops).where("hops > 0")


def distances(step: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(id, hops)`` with seeds at 0, breadth first, each hop from new nodes only."""
    start = seeds.select("id").distinct()
    if max_hops is not None and max_hops <= LAZY_HOPS:
        return _lazy_distances(step, start, max_hops)
    step = cut(step.distinct())
    frontier = cut(start)
    size = frontier.count()
    levels = [frontier.withColumn("hops", F.lit(0))]
    hop = 0
    while size and (max_hops is None or hop < max_hops):
        hop += 1
        seen = reduce(DataFrame.unionByName, levels).select("id")
        found = _advance(frontier, step, size <= BROADCAST_ROWS)
        frontier = cut(found.join(seen, "id", "left_anti"))
        size = frontier.count()
        if size:
            levels.append(frontier.withColumn("hops", F.lit(hop)))
        if len(levels) > 20:
            levels = [cut(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def _lazy_distances(step: DataFrame, start: DataFrame, max_hops: int) -> DataFrame:
    levels = [start.withColumn("hops", F.lit(0))]
    frontier = start
    for hop in range(1, max_hops + 1):
        frontier = _advance(frontier, step, small=False)
        levels.append(frontier.withColumn("hops", F.lit(hop)))
    return reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.min("hops").alias("hops"))


def reach_again(step: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Ids at the end of a walk of one or more steps; a seed on a cycle counts.

    A seed is on such a walk when one of its direct predecessors is a seed or is reached
    with a step to spare.
    """
    if max_hops is not None and max_hops < 1:
        return seeds.select("id").limit(0)
    if max_hops is not None and max_hops <= LAZY_HOPS:
        frontier, levels = seeds.select("id").distinct(), []
        for _ in range(max_hops):
            frontier = _advance(frontier, step, small=False)
            levels.append(frontier)
        return reduce(DataFrame.unionByName, levels).distinct()
    step = cut(step.distinct())
    dist = cut(distances(step, seeds, max_hops))
    onward = dist if max_hops is None else dist.where(F.col("hops") < max_hops)
    back = (
        step.join(onward.select(F.col("id").alias("at")), "at", "left_semi")
        .select(F.col("to").alias("id"))
        .join(dist.where("hops = 0").select("id"), "id", "left_semi")
    )
    return dist.where("hops > 0").select("id").unionByName(back).distinct()
