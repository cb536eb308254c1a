"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into permuted blocks by a hash. A source's target in words
is a number of whole passes over its blocks, some blocks of a last pass, and part of a
boundary block: documents in permuted order, those that do not fit are passed over, and what they leave
open is filled from the blocks behind it. These exact block quotas are split among output shards down a binary tree: a node draws
how many blocks of each source go left from the multivariate hypergeometric distribution. The shards'
draws are disjoint ranges of each source's permuted block order; rows are shuffled inside a shard.

Defined results: a null or empty text has size 0 and adds no words. A null source is a source of
its own, the last one. Repeated rows are mixed as often as they occur. Runs agree: all draws
depend on the seed and on the rows' keys and texts. An empty table gives no rows. Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.support import WORD, written

MOST_PASSES = 3
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SEED = 17
#: Boundary blocks of a source that are gone through one by one; what is still open then is filled from all later blocks at once.
ROUNDS = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` totals, one row a source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared again.
    The level at which shares stop is found with running sums over the sources sorted by
    limit over weight: the frame has one row a source, so that one task orders it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("double")).withColumn("limit", F.lit(float(most)) * F.col("size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    rows = rows.withColumn("before", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("size").over(everything) - F.col("before")) / F.col("left"))
    rows = rows.withColumn("open", F.col("limit") > F.col("level") * F.col("w"))
    # The level of the first source that does not reach its limit holds for all that follow.
    rows = rows.withColumn("level", F.min(F.when(F.col("open"), F.struct((F.col("limit") / F.col("w")).alias("ratio"), F.col("level")))).over(everything)["level"])
    share = F.coalesce(F.least("limit", F.col("level") * F.col("w")), F.col("limit"))
    return rows.select("source", F.col("size").alias("source_size"), share.alias("target"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``source, shard, n`` from block quotas ``source, quota``, one row a source.

    A row of the work frame is a node: a range of shards and its quota of each source. Each
    round halves all nodes in place; nodes are dealt out again once they are many.
    """
    spark = quotas.sparkSession
    # Sorted inside the list: rows of a sorted frame may be collected partition by partition in any order.
    ordered = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("null"), "source", "quota")))
    root = quotas.agg(ordered.alias("q")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), F.col("q.quota").alias("q"))

    def halve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for low, high, q in pdf.itertuples(index=False):
                q = np.asarray(q, np.int64)
                if high - low == 1:
                    out.append((low, high, q))
                    continue
                mid = (low + high) // 2
                draw = np.random.default_rng([seed, low, high])
                left = int(q.sum()) * (mid - low) // (high - low)
                some = draw.multivariate_hypergeometric(q, left, method="marginals") if len(q) else q
                out += [(low, mid, some), (mid, high, q - some)]
            yield pd.DataFrame(out, columns=["low", "high", "q"])

    nodes = root
    for level in range(max(0, shards - 1).bit_length()):
        if level % 6 == 5:
            nodes = nodes.repartition(1 << min(level, 10), "low")
        nodes = nodes.mapInPandas(halve, "low int, high int, q array<long>")
    numbered = quotas.select(F.col("source"), (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).alias("pos"))
    leaves = nodes.select(F.col("low").alias("shard"), F.posexplode("q").alias("pos", "n")).where(F.col("n") > 0)
    return leaves.join(F.broadcast(numbered), "pos").select("source", "shard", "n")


def copies(rows: DataFrame) -> DataFrame:
    """``source, block, h, k, words, room``: rows with words; those that repeat a key and a text are one."""
    found = rows.where(F.col("size") > 0).groupBy("source", "block", "h", "k").agg(F.count(F.lit(1)).alias("same"), F.max("size").alias("size"), F.max("room").alias("room"))
    return found.select("source", "block", "h", "k", (F.col("size") * F.col("same")).alias("words"), "room")


def first_fit(words: list[int], room: float) -> list[bool]:
    """Of each, in order, whether it fits into the room that those before it left; what does not fit is passed over."""
    fits = []
    for n in words:
        fits.append(n <= room)
        room -= n if fits[-1] else 0
    return fits


def filled(found: DataFrame) -> DataFrame:
    """The ``source, block, h, k, words`` that fill the ``room`` of their source in permuted order; bounded rows a source."""
    lists = found.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("block", "h", "k", "words"))).alias("rows"), F.max("room").alias("room"))
    fits = F.udf(first_fit, "array<boolean>")(F.col("rows.words"), F.col("room"))
    return lists.select("source", F.explode(F.arrays_zip("rows", fits.alias("fits"))).alias("r")).where("r.fits").select("source", "r.rows.*")


def plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``key, source, size, source_size, target, shards`` and, as ``carried_...``, the columns to carry.

    ``shards`` has the output shard of each copy the mix takes; empty if it takes none.
    """
    rows = sized(docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t"), *(F.col(c).alias(f"carried_{c}") for c in carry)), "t")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "k", "t")).drop("t")
    rows = written(rows, "sized")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    goal = goal.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(most))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    goal = written(goal, "goal")
    # One row a source: as small as the list of sources.
    rows = rows.join(F.broadcast(goal.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", F.pmod("h", "blocks"))

    # Which block of the last pass is the boundary: running sums over blocks, not over rows.
    block = written(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    running = Window.partitionBy("source").orderBy("block")
    left = goal.where("rest > 0").select(F.col("source").alias("s"), F.lit(-1).cast("long").alias("last"), F.col("rest").alias("gap"))
    steps, chosen = [], []
    for _ in range(ROUNDS):
        # What documents passed over in a boundary leave open goes on into the blocks behind it, up to another boundary.
        ahead = block.join(F.broadcast(left), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") > F.col("last")) & (F.col("gap") > 0)).drop("s")
        ahead = ahead.withColumn("before", F.sum("words").over(running) - F.col("words"))
        whole = F.col("before") + F.col("words") <= F.col("gap")
        edge = ~whole & (F.col("before") < F.col("gap"))
        step = ahead.where(whole | edge).groupBy(F.col("source").alias("s")).agg((F.max("block") + 1).alias("full"), F.max(F.when(edge, F.col("block"))).alias("b"), F.max(F.when(edge, F.col("gap") - F.col("before"))).alias("room"))
        step = written(step, "step")
        steps.append(step)
        cut = step.where(F.col("b").isNotNull())
        fits = written(filled(copies(rows.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))))), "filled")
        chosen.append(fits.withColumn("extra", F.lit(False)))
        took = fits.groupBy("source").agg(F.sum("words").alias("took"))
        left = cut.join(F.broadcast(took), F.col("source").eqNullSafe(F.col("s")), "left")
        left = written(left.select("s", F.col("b").alias("last"), (F.col("room") - F.coalesce("took", F.lit(0))).alias("gap")), "left")
        if left.where(F.col("gap") >= block_words).limit(1).count() == 0:
            break
    # Less than a block is open, as a rule: of each size, as many rows of the later blocks as could fit, in permuted order.
    late = rows.join(F.broadcast(left.withColumnRenamed("gap", "room")), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") > F.col("last")) & (F.col("size") <= F.col("room")))
    late = written(copies(late).where(F.col("words") <= F.col("room")), "late")
    some = late.groupBy("source", "words", "block").agg(F.count(F.lit(1)).alias("n"), F.max("room").alias("room"))
    some = some.withColumn("before", F.sum("n").over(Window.partitionBy("source", "words").orderBy("block")) - F.col("n"))
    some = some.where(F.col("before") * F.col("words") < F.col("room")).select(F.col("source").alias("s"), F.col("words").alias("w"), F.col("block").alias("b"))
    late = late.join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("words") == F.col("w")) & (F.col("block") == F.col("b")), "left_semi")
    chosen.append(filled(late).withColumn("extra", F.lit(True)))
    chosen = reduce(DataFrame.union, chosen).select(F.col("source").alias("cs"), F.col("block").alias("cb"), F.col("h").alias("ch"), F.col("k").alias("ck"), "extra")
    chosen = written(chosen, "chosen")
    steps = written(reduce(DataFrame.union, steps), "steps")
    edge = steps.where(F.col("b").isNotNull()).select("s", "b")

    # Blocks of the last pass: all up to the last boundary.
    full = steps.groupBy("s").agg(F.max("full").alias("full"))
    goal = goal.join(F.broadcast(full), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    full_last = F.coalesce("full", F.lit(0))
    quota = written(goal.select("source", "blocks", "passes", (F.col("passes") * F.col("blocks") + full_last).alias("quota"), "target"), "quotas")
    total = quota.agg(F.sum("target")).first()[0] or 0
    shards = max(1, int(-(-total // shard_words)))
    draws = split_tree(quota.select("source", "quota"), shards, seed)
    ends = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    draws = draws.withColumn("end", ends)
    draws = draws.select("source", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("d"))
    draws = draws.join(F.broadcast(quota.select(F.col("source").alias("s"), "blocks")), F.col("source").eqNullSafe(F.col("s")))
    drawn = draws.groupBy(F.col("s").alias("ds"), F.pmod("d", "blocks").alias("db")).agg(F.sort_array(F.collect_list(F.struct(F.floor(F.col("d") / F.col("blocks")).alias("turn"), "shard"))).alias("drawn"))

    drawn = written(drawn, "drawn")
    # Rows of later blocks that fill what is open go with the last boundary block, to the shard that drew it.
    at = left.join(F.broadcast(quota.select("source", "passes")), F.col("s").eqNullSafe(F.col("source"))).select("s", "last", "passes")
    at = at.join(drawn, F.col("s").eqNullSafe(F.col("ds")) & (F.col("last") == F.col("db")))
    at = at.select("s", F.filter("drawn", lambda x: x["turn"] == F.col("passes"))[0]["shard"].alias("with"))
    chosen = chosen.join(F.broadcast(at), F.col("cs").eqNullSafe(F.col("s")), "left").drop("s")

    out = rows.join(drawn, F.col("source").eqNullSafe(F.col("ds")) & (F.col("block") == F.col("db")), "left")
    out = out.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    # A few boundary blocks a source: a bounded number of words, shuffled with the rows where it is large.
    out = out.join(chosen, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")) & (F.col("h") == F.col("ch")) & F.col("k").eqNullSafe(F.col("ck")), "left")
    passed_over = F.col("b").isNotNull() & F.col("ch").isNull() & (F.col("size") > 0)
    kept = F.filter(F.coalesce("drawn", F.array().cast("array<struct<turn:bigint,shard:int>>")), lambda x: ~(passed_over & (x["turn"] >= F.col("passes"))))
    extra = F.when(F.col("extra"), F.array("with")).otherwise(F.array().cast("array<int>"))
    return out.select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.concat(F.transform(kept, lambda x: x["shard"]), extra).alias("shards"), *(f"carried_{c}" for c in carry))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = SEED, **more) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a document stands as often as the mix takes it.

    Rows are dealt by shard and shuffled inside it by a hash; the shard is the partition.
    """
    carry = tuple(c for c in docs.columns if c not in (key, source))
    planned = plan(docs, text, key, source, seed=seed, carry=carry, **more)
    own = [F.col(c if c in (key, source) else f"carried_{c}").alias(c) for c in docs.columns]
    out = planned.select(*own, F.posexplode("shards").alias("_turn", "_shard"))
    return out.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64(F.lit(seed), key, "_turn")).select(*docs.columns)
