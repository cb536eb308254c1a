"""Change history: churn per file and the files that change with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.model import NODE_COLUMNS, PropertyGraph
from graphloom.session import broadcast_if_small, cut, shares

LEAST_CO_CHANGES = 3
TOP_CO_CHANGES = 5
# Commits with more distinct files than this are never expanded into pairs of files.
WIDE_COMMIT = 500
# Mentions that one task sorts.
MENTIONS = 500_000


def file_churn(touches: DataFrame) -> DataFrame:
    """``(file, change_frequency, last_changed)`` from ``(commit, changed_at, file)``."""
    return touches.groupBy("file").agg(
        F.count("*").alias("change_frequency"), F.max("changed_at").alias("last_changed")
    )


def co_change_counts(touches: DataFrame, wide: int = WIDE_COMMIT) -> DataFrame:
    """Per file its best companions: ``(file, other, together)``, at most five, exact.

    A pair counts once for every pair of mentions in one commit. Commits of up to ``wide``
    files are expanded into pairs; each row meets at most ``wide`` others. A wider commit
    is not expanded: its files are grouped by the exact set of wide commits that mention
    them (their *signature*), and signatures are compared instead of files. One commit
    with a third of all files is then a handful of signatures.
    """
    mentions = cut(touches.groupBy("commit", "file").agg(F.count("*").alias("m")))
    # Commits are dealt out once, to as many tasks as their mentions ask for, and stay there.
    tasks = shares(mentions, MENTIONS)
    mentions = mentions.repartition(tasks, "commit")
    sizes = mentions.groupBy("commit").agg(F.count("*").alias("files"), F.max("m").alias("top_m"))
    sized = mentions.join(sizes, "commit")

    # A file can only reach the threshold if its mentions, each against the most often
    # mentioned file of that commit, add up to it.
    hopeful = (
        sized.groupBy("file")
        .agg(F.sum(F.col("m") * F.col("top_m")).alias("bound"))
        .where(F.col("bound") >= LEAST_CO_CHANGES)
        .select("file")
    )
    sized = cut(sized.join(hopeful, "file", "left_semi").select("commit", "file", "m", "files"))
    sized = sized.repartition(tasks, "commit")
    narrow = sized.where(F.col("files") <= wide).select("commit", "file", "m")
    broad = sized.where(F.col("files") > wide).select("commit", "file", "m")

    left = narrow.select("commit", "file", "m")
    right = narrow.select("commit", F.col("file").alias("other"), F.col("m").alias("om"))
    times = F.when(F.col("file") == F.col("other"), F.col("m") * (F.col("m") - 1)).otherwise(F.col("m") * F.col("om"))
    pairs = (
        left.join(right, "commit").groupBy("file", "other").agg(F.sum(times).alias("narrow")).where("narrow > 0")
    )
    if broad.isEmpty():
        counted = pairs.withColumnRenamed("narrow", "together")
    else:
        counted = _with_broad(pairs, broad)
    rank = W.partitionBy("file").orderBy(F.desc("together"), "other")
    return (
        counted.where(F.col("together") >= LEAST_CO_CHANGES)
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= TOP_CO_CHANGES)
    )


def _with_broad(pairs: DataFrame, broad: DataFrame) -> DataFrame:
    """Add the counts of wide commits, as far as they can enter a file's top five.

    Pairs seen in narrow commits get their exact total. Of the other companions only the
    first six in rank order (by wide count, then name) are listed per signature: a file
    itself may be one of them, and any companion with narrow commits on top of that is
    already listed with a higher total.
    """
    # A signature is the number of its commits and two sums of their hashes: no list of commits is gathered, however many a file has.
    hashed = lambda salt: F.sum(F.xxhash64(F.lit(salt), "commit", "m").cast("decimal(20,0)")).cast("string")
    spread = cut(
        broad.groupBy("file").agg(
            F.concat_ws("|", F.count("*").cast("string"), hashed(0), hashed(1)).alias("sig"), F.sum(F.col("m") * (F.col("m") - 1)).alias("own")
        )
    )
    members = spread.select("file", "sig")
    heads = cut(members.groupBy("sig").agg(F.min("file").alias("file")))
    terms = broad.join(broadcast_if_small(heads), "file").select("sig", "commit", "m")
    other_terms = terms.select(F.col("sig").alias("osig"), "commit", F.col("m").alias("om"))
    sig_pairs = (
        terms.join(other_terms, "commit").groupBy("sig", "osig").agg(F.sum(F.col("m") * F.col("om")).alias("wide"))
    )

    # The first members of each signature by name are all that can be listed for it.
    by_name = W.partitionBy("sig").orderBy("file")
    leaders = (
        members.withColumn("n", F.row_number().over(by_name))
        .where(F.col("n") <= TOP_CO_CHANGES + 1)
        .select(F.col("sig").alias("osig"), F.col("file").alias("other"))
    )
    order = W.partitionBy("sig").orderBy(F.desc("wide"), "other")
    listed = (
        sig_pairs.where(F.col("wide") >= LEAST_CO_CHANGES)
        .join(leaders, "osig")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= TOP_CO_CHANGES + 1)
        .select("sig", "other")
    )
    candidates = members.join(listed, "sig").select("file", "other")
    own = spread.select("file", F.col("file").alias("other"), "own")
    all_pairs = (
        pairs.select("file", "other", "narrow")
        .unionByName(candidates.select("file", "other", F.lit(0).cast("bigint").alias("narrow")))
        .unionByName(own.select("file", "other", F.lit(0).cast("bigint").alias("narrow")))
        .groupBy("file", "other")
        .agg(F.sum("narrow").alias("narrow"))
    )
    sigs_a = members.select("file", "sig")
    sigs_b = members.select(F.col("file").alias("other"), F.col("sig").alias("osig"))
    zero = F.lit(0).cast("bigint")
    return (
        all_pairs.join(sigs_a, "file", "left")
        .join(sigs_b, "other", "left")
        .join(sig_pairs, ["sig", "osig"], "left")
        .join(own, ["file", "other"], "left")
        .select(
            "file",
            "other",
            (
                F.col("narrow")
                + F.when(F.col("file") == F.col("other"), F.coalesce("own", zero)).otherwise(F.coalesce("wide", zero))
            ).alias("together"),
        )
    )


def co_changes(touches: DataFrame, wide: int = WIDE_COMMIT) -> DataFrame:
    """``(file, co_changes)``: companions in order, at most five; files without any left out."""
    best = co_change_counts(touches, wide)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "other")))
    return best.groupBy("file").agg(F.transform(ordered, lambda e: e["other"]).alias("co_changes"))


def file_history(touches: DataFrame, wide: int = WIDE_COMMIT) -> DataFrame:
    """Churn, last change and companions of every file."""
    together = co_changes(touches, wide)
    empty = F.array().cast("array<string>")
    return (
        file_churn(touches)
        .join(together, "file", "left")
        .withColumn("co_changes", F.coalesce("co_changes", empty))
    )


def update_file_history(graph: PropertyGraph, history: DataFrame) -> PropertyGraph:
    """Set history on known files; unknown files are ignored, others keep theirs."""
    fresh = history.select(
        F.col("file"),
        F.col("change_frequency").alias("__cf"),
        F.col("last_changed").cast("string").alias("__lc"),
        F.col("co_changes").alias("__cc"),
        F.lit(True).alias("__hit"),
    )
    files = graph.labelled("File").join(fresh, "file", "left")
    files = files.select(
        *[
            F.when(F.col("__hit"), F.col(new)).otherwise(F.col(old)).alias(old)
            if (new := {"change_frequency": "__cf", "last_changed": "__lc", "co_changes": "__cc"}.get(old))
            else F.col(old)
            for old in NODE_COLUMNS
        ]
    )
    return graph.with_part("File", files)
