"""Predicates whose null and match rules differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(col: Column, pattern: str) -> Column:
    """Whole-string regular expression match (``rlike`` alone finds a part)."""
    return col.rlike(f"\\A(?:{pattern})\\z")


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) == ""


def usable_features(features: Column) -> Column:
    """True unless the list is null or is exactly ``['unknown']``."""
    only_unknown = (F.size(features) == 1) & (F.get(features, F.lit(0)) == "unknown")
    return features.isNotNull() & ~F.coalesce(only_unknown, F.lit(False))
