"""Session defaults, lineage cutting and size-checked broadcast."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound, in rows, for a key-only side that may be broadcast.
BROADCAST_ROWS = 500_000
# What a task reads of files within ``short_splits``.
SPLIT = "16m"


def build_session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints go when the frames that need them are gone.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. Where it is unset a temporary folder is used, but
    only on a local master: executors of a cluster cannot share a machine-local path.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_afresh(df: DataFrame) -> DataFrame:
    """``cut`` for what the next round of a loop is made from: the planner's guess of its size stays behind with the lineage.

    A cut frame carries the guess of the plan it came from, and a join multiplies the guesses of its sides. Where both sides come from the round
    before, the digits of that number double every round; after some twenty of them they fill the driver.
    """
    done, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


def cut_in_place(df: DataFrame) -> DataFrame:
    """``cut`` for work on rows that were dealt out by a key before: what follows knows how they lie and shuffles nothing for that key.

    A plan that may change while it runs says nothing about how its rows lie, so this one is made in full beforehand.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` after counting it, up to a bound; leave it as it is beyond.

    Meant for frames that are cheap to count: cut frames and narrow dimension scans.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shares(df: DataFrame, rows: int) -> int:
    """In how many tasks ``df`` is worked on, at ``rows`` rows each: as many as run at once at least, more with more rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` for work that costs much more than reading; a small file is else one task's.

    Meant, as ``shares``, for frames that are cheap to count.
    """
    return df.repartition(shares(df, rows), *keys)


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for what is made in full within: a plan takes them when it is run."""
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def exchanges(spark: SparkSession, tasks: int):
    """Within it shuffles have ``tasks`` partitions. Joins and aggregates stay the planner's, which still splits skewed ones.

    Partitions are as large as they should be and are not put together: the planner's size for that is compressed, and narrow rows take many times of it.
    """
    return held(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def short_splits(spark: SparkSession):
    """Within it files are read in short splits, for rows that grow much when they are read."""
    return held(spark, {"spark.sql.files.maxPartitionBytes": SPLIT})


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side.

    Of rows that were generated, exploded or read out of texts the planner knows no sizes: it goes by those of the
    files they come from, and would gather any number of them on the driver.
    """
    return left.join(right.hint("merge"), on, how)
