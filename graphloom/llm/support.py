"""What the corpus operators share: folds, shared tables, bounded samples, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.session import ensure_checkpoint_dir

#: Words of a text: maximal runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts scored at once.
SCORED_ROWS = 500
#: Texts may be very long: what is sent to Python at once is bounded by bytes and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)).cast("int")


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether a row is kept away from learning; a row without a key is not held out, and not learned from either."""
    return F.coalesce(fold(key, parts) == part, F.lit(False))


def learned(key: Column, parts: int, part: int) -> Column:
    return F.coalesce(fold(key, parts) != part, F.lit(False))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the session's shared folder, read back: columns, pruning, no lineage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uniform(*columns: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(rows: DataFrame, group: str, key: str, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows of each group, those with the smallest hash of ``key``.

    Groups are counted first, so that only about twice the bound of each group is ordered, whatever its size.
    """
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    u = uniform(key, seed=seed)
    near = rows.join(F.broadcast(n), rows[group].eqNullSafe(n[group])).drop(n[group])
    near = near.where(u < F.lit(2.0 * bound + 50) / F.col("_n")).drop("_n")
    w = Window.partitionBy(group).orderBy(u, F.col(key))
    return near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= bound).drop("_rank")


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's limits for batches of rows sent to Python set for texts."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def scored(docs: DataFrame, text: str, keep: tuple[str, ...], added: str, score: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """The columns ``keep`` of ``docs``, and those of the DDL ``added`` that ``score`` gives for the texts of a batch."""
    keep = list(keep)
    columns = keep if text in keep else [*keep, text]
    rows, at = bounded_batches(docs).select(*columns), columns.index(text)
    schema = StructType([rows.schema[c] for c in keep] + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(first, SCORED_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *score(part.column(at).to_pylist())], schema.names)
        # The worker lives on: what it does not use goes back.
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every end of a link: the smallest id reachable.

    Labels fall to the smallest among neighbours, then to the label of the label; each round
    is a written table. Rounds are about the logarithm of the longest shortest path.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x") != F.col("y"))
    edges = written(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "c").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("top"))
        moved = lower.join(up, "low").select("id", F.least("low", "top").alias("component"), (F.least("low", "top") < F.col("component")).alias("moved"))
        moved = written(moved, "labels")
        labels = moved.drop("moved")
        if moved.where("moved").limit(1).count() == 0:
            return labels
