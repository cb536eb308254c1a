"""Registered queries of the corpus operators, with SQL where it can state the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import collocations, language, lexical_search, line_dedup, mixing, near_vectors, nearest, ngram_join, packing, quality, toxicity, url_filter, warc
from graphloom.llm.support import held_out, learned, table
from graphloom.session import broadcast_if_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents of three folds of four."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(learned(F.col("doc_id"), 4, 2)))
    return language.identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    packed = packing.pack(packing.pieces(table(spark, folder, "documents")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to the sources' weights: what the mix takes of each."""
    planned = mixing.plan(table(spark, folder, "documents"))
    taken = (F.col("size") * F.size("shards")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken, "shards")


def with_labels(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int) -> DataFrame:
    """``doc_id, text, label`` of the labelled documents that may be learned from."""
    marks = labels.where(learned(F.col("doc_id"), parts, part) & F.col(label).isNotNull()).select("doc_id", label)
    return docs.select("doc_id", "text").join(broadcast_if_small(marks), "doc_id")


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from the labels of four folds of five."""
    docs = table(spark, folder, "documents")
    model = quality.fit(with_labels(docs, table(spark, folder, "labels"), "quality", 5, 0))
    scored = quality.judge(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score and toxic spans of every document, learned from the labels of three folds of four."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(with_labels(docs, table(spark, folder, "labels"), "toxic", 4, 2))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", predicted, "spans")


@query
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents under links of 85 % and more of common 4-word shingles."""
    return ngram_join.join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of equal labels with a cosine of 0.98 and more."""
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector among all other vectors."""
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the rules, else of the host's reputation, on the URL of every page."""
    return url_filter.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL["op2_url_filter"] = url_filter.SQL


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived as a WARC record, and what the archives say when read back."""
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT digest, min(page_id) AS first FROM rows WHERE octet_length(body) >= 100 GROUP BY digest
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (digest)
"""


@query
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that at least three documents share, kept in the largest of them."""
    kept = line_dedup.without_shared_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL["op13_line_dedup"] = line_dedup.SQL


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2000 phrases of every language whose words stand together more often than their parts would."""
    return collocations.collocations(table(spark, folder, "documents"))


SQL["op11_collocations"] = collocations.SQL


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 documents of the largest weighted term overlap with every benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op12_lexical_search"] = lexical_search.SQL
