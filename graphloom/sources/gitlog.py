"""Captured ``git log --name-only --format=COMMIT|%cI`` text as touched files.

The text source cuts records at the header marker, so a record is one commit wherever a
log is cut into input splits, and no order between lines has to be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "COMMIT|"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``(commit, changed_at, file)``, a row per mention of a file."""
    records = spark.read.option("lineSep", HEADER).text(path).select(
        F.col("value"), F.monotonically_increasing_id().alias("commit")
    )
    return touched(records)


def touched(records: DataFrame) -> DataFrame:
    """``(commit, changed_at, file)`` from ``(commit, value)`` with one commit per value."""
    lines = F.transform(F.split("value", "\\n"), lambda x: F.trim(F.regexp_replace(x, "\\r", "")))
    rows = records.select("commit", lines.alias("lines")).select(
        "commit", F.col("lines")[0].alias("changed_at"),
        F.explode(F.filter(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: x != "")).alias("file"),
    )
    return rows.where("changed_at <> ''")
