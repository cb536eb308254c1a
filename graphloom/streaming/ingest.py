"""Incremental load of a folder of JSON line files into a stored graph.

Each trigger is one change of the store: its records are merged into the buckets they touch, later batches
winning. The number of the batch is kept with the state, so that a batch that is replayed after a failure
changes nothing if it was applied, and all of it if it was not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.session import cut
from graphloom.sources import jsonl
from graphloom.sources.graph_store import BUCKETS, GraphStore


def _store(store: str, buckets: int):
    def write(batch: DataFrame, epoch: int) -> None:
        records = cut(jsonl.parse_lines(jsonl.in_file_order(batch)))
        GraphStore(batch.sparkSession, store, buckets).apply(jsonl.node_records(records), jsonl.edge_records(records), epoch=epoch)

    return write


def ingest(spark: SparkSession, folder: str, store: str, progress: str, buckets: int = BUCKETS) -> None:
    """Load the files of ``folder`` not yet loaded, then stop. ``progress`` keeps what is done; ``buckets`` counts for a new store."""
    lines = jsonl.located(spark.readStream.format("text").load(folder), F.col("_metadata.file_modification_time").alias("time"))
    query = lines.writeStream.foreachBatch(_store(store, buckets)).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def current_graph(spark: SparkSession, store: str) -> PropertyGraph:
    """The graph as of the last finished batch."""
    return GraphStore(spark, store).graph()
