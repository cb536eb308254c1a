"""A corpus pipeline: language, quality, near duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run`` writes
each stage's result as Parquet in the session's shared folder and rereads it for the next. Models are
learned from ``documents`` and ``labels`` of ``sf_dir``, by the same folds as the operators' own queries.

Defined results: a null or empty text has no language and goes in the first stage; rows without
a key stay where they are not rejected. Empty tables give empty results. Columns of ``docs`` beside those of
``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, mixing, ngram_join, packing, quality
from graphloom.llm.queries import with_labels
from graphloom.llm.support import learned, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with a posterior of half and more."""
    known = table(spark, sf_dir, "documents")
    model = language.fit(known.where(learned(F.col("doc_id"), 4, 2)))
    found = language.identify(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(with_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 5, 0))
    return quality.judge(docs, model, keep=COLUMNS).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 80 % and more of common 5-word shingles."""
    return ngram_join.distinct_documents(docs, n=5, share=(80, 100)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, shuffled."""
    return mixing.mix(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in windows of 4096 tokens."""
    out = packing.pack(packing.pieces(docs))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", identified), ("quality", good), ("near_duplicates", distinct), ("mixture", mixed), ("packing", packed)]

#: Models and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
