"""Collocations: phrases whose words stand together more often than their parts would.

A-Z are lower-cased, texts are split at ``[.,;:!?]`` and line ends into pieces and those at spaces and tabs into words.
Within one language, f(phrase) counts all occurrences in pieces, overlaps included. Phrases of 2 to 5 words with
f >= ``LEAST`` are candidates; each is cut in two where ``floor(1000 * f * n / (f(first) * f(rest)))`` is lowest.

Every word and every n-gram gets a Rabin-Karp fingerprint from prefix polynomials modulo 2**64, over bytes for words and
over the words' fingerprints for n-grams. The first rounds, one for each length, shuffle only fingerprints and counts, summed in the task
before. An n-gram is counted only if both its shorter ends were frequent, which a bit filter of
frequent fingerprints tells; the filter may let more pass, never less, and is at most ``FILTER_BITS`` bits whatever the corpus.

The last round turns frequent fingerprints into text. In a task, a fingerprint points to its first occurrence in the task's texts;
all its other occurrences are compared with that text, word by word, and those that differ are grouped by their words. Only then are
phrases written out, with their counts, and summed by language and text. So no
count rests on a fingerprint, and no text but that of frequent phrases is shuffled.

Defined results: a null or empty text has no words; a null language is ``und``. Rows that repeat count as often
as they occur. A corpus without a candidate, or without rows, gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bytewords import UNKNOWN, Words
from graphloom.llm.support import bounded_batches, written
from graphloom.session import broadcast_if_small

LEAST, LONGEST, SHOWN = 100, 5, 2000
#: A candidate goes if a longer one that holds it has this percentage of its occurrences.
COVERED = 100
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: N-grams of a task that are summed at once.
SUMMED = 4_000_000
#: Bits of a filter for each frequent n-gram, and in all.
BITS_EACH, LEAST_BITS, FILTER_BITS = 16, 1 << 16, 1 << 28

KINDS = np.zeros(256, np.uint8)
KINDS[list(BLANKS)], KINDS[list(SEPARATORS)] = 1, 2


class Filter:
    """A bit for each frequent fingerprint: its leading bits say where."""

    def __init__(self, words: np.ndarray, log: int):
        self.words, self.log = words, log

    def has(self, prints: np.ndarray) -> np.ndarray:
        at = prints >> np.uint64(64 - self.log)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_filter(frequent: DataFrame) -> Filter | None:
    """The filter of the column ``fp``; none without rows. What comes to the driver is the filter, of bounded size."""
    n = frequent.count()
    if not n:
        return None
    log = ceil(log2(min(max(n * BITS_EACH, LEAST_BITS), FILTER_BITS)))
    place = F.shiftrightunsigned("fp", 64 - log)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = frequent.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << (log - 6), np.uint64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words, log)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("g"))


def counted_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, fp, n`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(0), KINDS, batch.column(1))
            prints, first, n = np.unique(words.prints(words.grams(1), 1), return_index=True, return_counts=True)
            names = pa.array(words.langs, pa.string()).take(pa.array(words.lang[first]))
            yield pa.RecordBatch.from_arrays([names, pa.array(prints.view(np.int64)), pa.array(n, pa.int64())], ["lang", "fp", "n"])

    rows = _texts(docs, text, lang).mapInArrow(run, "lang string, fp long, n long")
    return rows.groupBy("lang", "fp").agg(F.sum("n").alias("n"))


def counted_grams(docs: DataFrame, k: int, shorter: Broadcast, text: str = "text", lang: str = "lang") -> DataFrame:
    """``fp, n`` of the n-grams of ``k`` words whose two ends of k - 1 words pass the filter ``shorter``."""

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        prints, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n, pa.int64())], ["fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, parts, held = shorter.value.has, [], 0
        for batch in batches:
            words = Words(batch.column(0), KINDS, batch.column(1))
            at = words.grams(k)
            at = at[passes(words.prints(at, k - 1))]
            at = at[passes(words.prints(at + 1, k - 1))]
            parts.append(words.prints(at, k))
            held += len(at)
            if held > SUMMED:
                yield summed(parts)
                parts, held = [], 0
        if held:
            yield summed(parts)

    return _texts(docs, text, lang).mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


def spelled(docs: DataFrame, filters: Broadcast, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, words, phrase, f`` of all phrases that pass the filters (one for each length), counted by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(0), KINDS, batch.column(1))
            exact = words.exact()
            for k, found in enumerate(filters.value, 1):
                at = words.grams(k)
                at = at[found.has(words.prints(at, k))]
                pointer, n = words.distinct(at, k, exact)
                names = pa.array(words.langs, pa.string()).take(pa.array(words.lang[pointer]))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(n), k, np.int32)), words.phrases(pointer, k), pa.array(n, pa.int64())], ["lang", "words", "phrase", "n"])

    rows = _texts(docs, text, lang).mapInArrow(run, "lang string, words int, phrase string, n long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, n`` of every language, and ``lang, words, phrase, f`` of every phrase of 1 to ``longest`` words with f >= ``least``."""
    sc = docs.sparkSession.sparkContext
    singles = written(counted_words(docs, text, lang), "words")
    totals = singles.groupBy("lang").agg(F.sum("n").alias("n"))
    filters, found = [], bit_filter(singles.where(F.col("n") >= least).select("fp"))
    while found is not None and len(filters) < longest:
        filters.append(found)
        if len(filters) < longest:
            grams = counted_grams(docs, len(filters) + 1, sc.broadcast(found), text, lang)
            found = bit_filter(written(grams.where(F.col("n") >= least).select("fp"), "grams"))
    phrases = spelled(docs, sc.broadcast(filters), text, lang).where(F.col("f") >= least)
    return totals, written(phrases, "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shown: int | None = SHOWN, covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``, each language's first ``shown`` (all, if null)."""
    totals, phrases = frequent_phrases(docs, text, lang, least, longest)
    candidates = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "words")

    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: joined(s, m))))
    held = candidates.where("words > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")

    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "tail", "r"), ["lang", "tail"]).join(broadcast_if_small(totals), "lang")
    # Products of counts pass 64 bits: exact decimals.
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", whole("a") * F.lit(1000).cast("decimal(4,0)") * whole("n"), whole("l") * whole("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if shown is None else ranked.where(F.col("rank") <= shown)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), grams AS (
  SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM starts, range(1, {LONGEST + 1}) AS ks(k) WHERE i + k - 1 <= len(w)
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang
), phrases AS (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE words > 1
), inner_parts AS (
  SELECT c.lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, a
  FROM candidates c, range(2, {LONGEST}) AS ms(m), range(1, {LONGEST}) AS ss(s) WHERE m < words AND s + m - 1 <= words
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM candidates c LEFT JOIN held USING (lang, phrase), range(1, {LONGEST}) AS ks(k)
  WHERE k < words AND (longer IS NULL OR 100 * longer < {COVERED} * a)
), scored AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN phrases h ON h.lang = c.lang AND h.phrase = head JOIN phrases t ON t.lang = c.lang AND t.phrase = tail JOIN totals o ON o.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= {SHOWN}
"""
