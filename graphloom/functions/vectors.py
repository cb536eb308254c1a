"""Vector columns: dot products, norms, cosine, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Plain cosine, 0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine moved to [0, 1]: what thresholds and search scores are stated in."""
    return (F.lit(1.0) + cosine(a, b)) / 2


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus cosine; what clustering uses."""
    return F.lit(1.0) - cosine(a, b)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def is_zero(values: Sequence[float] | None) -> bool:
    return not values or all(v == 0 for v in values)
