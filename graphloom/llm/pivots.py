"""Vectors described by their nearest reference points, in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.support import uniform


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def reference_points(vectors: DataFrame, key: str, vector: str, most: int, seed: int) -> np.ndarray:
    """At most ``most`` usable vectors, from a sample of four times as many: those with the smallest hash of their key.

    Vectors nearer to one already taken than half the usual distance are passed over while others last, so
    that a large group of near copies has one reference point and not a share of all. The index
    is fitted on the sample, which is all that the driver holds. Vectors of another length than the commonest are no reference points.
    """
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    near = rows.where(uniform("k", seed=seed) < F.lit((5.0 * most + 50) / max(1, n)))
    found = near.orderBy(uniform("k", seed=seed), "k").limit(4 * most).collect()
    lengths = [len(r["v"]) for r in found]
    if not lengths:
        return np.zeros((0, 0))
    common = max(sorted(set(lengths)), key=lengths.count)
    x = np.array(list(dict.fromkeys(tuple(r["v"]) for r in found if len(r["v"]) == common)), np.float64)
    squares = (x**2).sum(axis=1)
    least = np.median(squares[:500, None] + squares[None, :500] - 2 * x[:500] @ x[:500].T) / 4
    taken: list[int] = []
    closest = np.full(len(x), np.inf)
    for i in range(len(x)):
        if len(taken) < most and closest[i] >= least:
            taken.append(i)
            closest = np.minimum(closest, squares + squares[i] - 2 * x @ x[i])
    others = sorted(set(range(len(x))) - set(taken))
    return x[sorted(taken + others[: most - len(taken)])]


def order(x: np.ndarray, pivots: np.ndarray, first: int) -> np.ndarray:
    """Of each row, its ``first`` nearest reference points in order; ties to the smaller number."""
    gap = (pivots**2).sum(axis=1)[None] - 2.0 * (x @ pivots.T)
    return np.argsort(gap, axis=1, kind="stable")[:, :first]

