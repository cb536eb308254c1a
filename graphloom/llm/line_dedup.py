"""Lines that many documents share stay in one document only.

A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least ``LEAST_CHARS`` code points
that at least ``LEAST_DOCUMENTS`` documents hold loses all its lines except those of the largest document.

Hashes of keys (128 bits) are partitioned by range and sorted there by hash, document from the largest down and position, so that one
stream over a partition meets the first document of a key before all others. Texts are not
shuffled for it: what comes back is a bitmap of kept lines for each document, in words of 64
lines of which only those with a dropped line are stored.

A key with more rows than the even share of a partition would make one stream long. There are at most as many such keys as
partitions; they are counted with partial aggregates and decided by a join with these counts, so they stay out of the sort.

Only DataFrame functions are used. Defined results: a null or empty text is one empty line. Rows that repeat a key of
documents are one document, but each row keeps or loses lines of its own. A row without a document key keeps all lines and counts for
nothing. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.support import written

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: What is stripped from the ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Lines of one word of a bitmap.
WORD_LINES = 64
#: Bitmaps are broadcast up to so many documents and words; beyond, texts are shuffled to them.
BROADCAST_DOCUMENTS, BROADCAST_WORDS = 500_000, 4_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``h, h2, d, t, pos`` of every line whose key is long enough: hash of the line's key, document, hash of the row's text, position."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), split_lines(ascii_lower(F.col(text))).alias("lines"))
    lines = rows.select("d", "t", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("d", "t", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= least_chars)
    return lines.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "d", "t", "pos")


def dropped_lines(rows: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``d, t, pos`` of the lines of ``key_rows`` that go."""
    spark = rows.sparkSession
    share = max(1, rows.count() // int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = written(rows.groupBy("h", "h2").count().where(F.col("count") > share).select("h", "h2"), "hot")
    goes = (F.col("documents") >= least_documents) & (F.col("d") < F.col("top"))

    key = Window.partitionBy("h", "h2")
    stream = rows.join(F.broadcast(hot), ["h", "h2"], "left_anti").repartitionByRange("h", "h2")
    stream = stream.sortWithinPartitions("h", "h2", F.desc("d"), "t", "pos")
    stream = stream.withColumns({"top": F.first("d").over(key.orderBy(F.desc("d"))), "order": F.dense_rank().over(key.orderBy(F.desc("d")))})
    light = stream.withColumn("documents", F.max("order").over(key)).where(goes).select("d", "t", "pos")

    often = rows.join(F.broadcast(hot), ["h", "h2"], "left_semi")
    counts = often.groupBy("h", "h2", "d").agg(F.lit(1).alias("one")).groupBy("h", "h2").agg(F.count("one").alias("documents"), F.max("d").alias("top"))
    heavy = often.join(F.broadcast(counts), ["h", "h2"]).where(goes).select("d", "t", "pos")
    return light.union(heavy)


def bitmaps(dropped: DataFrame) -> DataFrame:
    """``d, t, dropped, keep`` of the documents that lose lines: ``keep`` has a word for each 64 lines of which one goes."""
    word, bit = F.floor(F.col("pos") / WORD_LINES).cast("int"), F.pmod(F.col("pos"), F.lit(WORD_LINES))
    words = dropped.groupBy("d", "t", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("gone"))
    pair = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("d", "t").agg(F.sum(F.bit_count("gone")).cast("long").alias("dropped"), F.sort_array(F.collect_list(pair)).alias("keep"))


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``d, t, dropped, keep``: the document's key, the hash of its text, how many lines go, and which stay.

    ``keep`` is an array of ``(word, bits)``: bit i of a word says whether line 64 * word + i stays. Words without
    an entry keep all their lines, and so do documents without a row.
    """
    rows = written(key_rows(docs, text, key, least_chars), "line_keys")
    return written(bitmaps(dropped_lines(rows, least_documents)), "bitmaps")


def _kept(lines: Column, keep: Column) -> Column:
    words = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / WORD_LINES).cast("int"))
    by_word = F.map_from_entries(keep)
    full = F.transform(words, lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(-1).cast("long")))
    return F.struct(lines.alias("lines"), full.alias("full"))


def kept_text(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_lines, n_dropped, kept`` of every row of ``docs``: its text without the lines that ``found`` drops."""
    size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keep")), F.lit(0))).first()
    small = size[0] <= BROADCAST_DOCUMENTS and size[1] <= BROADCAST_WORDS
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(found) if small else found, ["d", "t"], "left")
    lines = split_lines(F.col("text"))
    state = rows.select("d", "text", "dropped", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("keep").isNotNull(), _kept(lines, F.col("keep"))).alias("state"))
    bit = lambda i: F.getbit(F.get("state.full", F.floor(i / WORD_LINES).cast("int")), F.pmod(i, F.lit(WORD_LINES)))
    left = F.array_join(F.filter("state.lines", lambda line, i: bit(i) == 1), "\n")
    whole = F.coalesce("text", F.lit(""))
    return state.select(F.col("d").alias(key), "n_lines", F.coalesce("dropped", F.lit(0).cast("long")).alias("n_dropped"), F.when(F.col("state").isNull(), whole).otherwise(left).alias("kept"))


def without_shared_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """``key, n_lines, n_dropped, kept`` of every row."""
    return kept_text(docs, keep_bitmaps(docs, text, key, **more), text, key)


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         trim(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}
), judged AS (
  SELECT doc_id, pos, line, top IS NOT NULL AND doc_id < top AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
