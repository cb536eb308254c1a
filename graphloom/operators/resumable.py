"""Work lists answered by a slow or failing callable, in batches that are kept.

Rows are dealt into batches by a hash of their key. The answers of a batch are written to the log, a folder of Parquet, before the
next begins; a run that starts again leaves out every row that has an answer there, so at most the calls of the batch that was under way when the
session was lost are made twice. A call that fails is made again after a pause, which doubles each time;
a row whose calls all fail is set aside with the reason, and is tried anew by the next run. A callable that raises ``Stop`` ends the run after
its batch: what that batch has answered is kept first.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.session import broadcast_if_small, cut

BATCH_ROWS, CALLS_AT_ONCE = 1000, 8
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE = 4, 1.0, 30.0
_STATE = "state string, reason string, attempts int"


class Stop(Exception):
    """Raised by a callable when no further call makes sense: a spent quota, a service that is gone."""


class Stopped(RuntimeError):
    """A run that a callable ended; what was answered before is in the log."""


def _log_schema(rows: DataFrame, key: str, answer: str) -> StructType:
    return StructType([rows.schema[key], *StructType.fromDDL(f"answer struct<{answer}>, {_STATE}").fields])


def logged(spark: SparkSession, log: str, schema: StructType) -> DataFrame:
    """All that the log has of finished batches."""
    try:
        return spark.read.schema(schema).parquet(log).select(*schema.names)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _calling(call: Callable[[dict], dict], key: str, attempts: int, pause: float, longest: float):
    def answered(row: dict) -> tuple:
        for n in range(1, attempts + 1):
            try:
                return call(row), "done", None, n
            except Stop as problem:
                return None, "stopped", repr(problem), n
            except Exception as problem:  # noqa: BLE001: whatever a service raises sets its row aside
                reason = repr(problem)[:1000]
                if n < attempts:
                    time.sleep(min(longest, pause * 2 ** (n - 1)))
        return None, "failed", reason, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if stopped:
                    break
                found = answered(row)
                stopped = found[1] == "stopped"
                out.append((row[key], *found))
            yield pd.DataFrame(out, columns=[key, "answer", "state", "reason", "attempts"])

    return run


def answer_rows(
    rows: DataFrame, call: Callable[[dict], dict], answer: str, log: str, key: str = "id", batch_rows: int = BATCH_ROWS, at_once: int = CALLS_AT_ONCE,
    attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE,
) -> DataFrame:
    """``key`` and the fields of ``answer`` (a DDL) of the rows that have an answer, of this run or one before.

    ``call(row)`` gets a row as a dictionary and returns the fields of the answer. ``at_once`` calls are made side by side.
    """
    spark, schema = rows.sparkSession, _log_schema(rows, key, answer)
    done = logged(spark, log, schema).where("state = 'done'").select(key)
    todo = cut(rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(broadcast_if_small(done), key, "left_anti"))
    batches = -(-todo.count() // batch_rows)
    run = uuid.uuid4().hex[:12]
    for b in range(batches):
        part = todo.where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(batches)) == b).repartition(at_once)
        folder = f"{log}/run={run}/batch={b}"
        part.mapInPandas(_calling(call, key, attempts, pause, longest), schema).write.parquet(folder)
        problem = spark.read.schema(schema).parquet(folder).where("state = 'stopped'").select("reason").first()
        if problem:
            raise Stopped(f"batch {b + 1} of {batches}: {problem[0]}")
    return logged(spark, log, schema).where("state = 'done'").dropDuplicates([key]).select(key, "answer.*")


def set_aside(rows: DataFrame, answer: str, log: str, key: str = "id") -> DataFrame:
    """``key, reason, attempts`` of rows of the work list that failed and have no answer yet; the last failure of each."""
    found = logged(rows.sparkSession, log, _log_schema(rows, key, answer))
    done = found.where("state = 'done'").select(key)
    failed = found.where("state = 'failed'").join(done, key, "left_anti").groupBy(key)
    return failed.agg(F.max("reason").alias("reason"), F.sum("attempts").cast("int").alias("attempts")).join(rows.select(key).distinct(), key, "left_semi")
