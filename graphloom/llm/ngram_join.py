"""Exact Jaccard join of documents on word n-grams by vertical partitioning.

Documents with equal n-gram sets are one class. The n-grams' global order is cut into
fragments. A first pass over fragments of all sets counts, for each class, the n-grams that
another class has too; a class with fewer than the threshold's share cannot link and is left.
Those that remain are ordered rarest n-gram first; classes that share an n-gram of their
prefixes are candidate pairs, whose overlaps are counted in each fragment and summed.

Groups of near copies are not expanded to all pairs: each candidate is first compared with one
leader of every list it stands in, and only pairs between different components of these links are then formed. No pair
whose link could join two components is left out, so that components are those of all links.

Defined results: a null or empty text, or one without a word, has 0 n-grams and is its own component. A
text with fewer words than n is one n-gram. Texts are read in whole. Rows that repeat a key get a row each. A row without a key links with
nothing and has a null component. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.support import bounded_batches, components, scored, written
from graphloom.session import broadcast_if_small

WORDS = 4
#: Link if ``SHARE[1]`` * intersection >= ``SHARE[0]`` * union.
SHARE = (85, 100)
#: N-grams of a fragment of the first pass, about; fragments at least.
FRAGMENT_GRAMS, LEAST_FRAGMENTS = 2_000_000, 64
#: Fragments of the order by frequency in which partial overlaps are counted.
FRAGMENTS = 8
REMEMBERED = 200_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a text; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = (total ^ (total >> np.uint64(29))) * _MIX[i % 4] + h[i : len(words) - k + 1 + i]
    return np.unique(_mixed(total))


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def keys(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS) -> DataFrame:
    """``k, n, c, c2`` of every row: its key, set size, and the two halves of the set's digest; ``c`` names the class."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second = [], [], []
            for t in batch.column(1).to_pylist():
                s = gram_set(t, n)
                a, b = _digest(s)
                sizes.append(len(s))
                first.append(a)
                second.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["k", "n", "c", "c2"])

    return bounded_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n long, c long, c2 long")


def shared_grams(docs: DataFrame, fragments: int, text: str = "text", n: int = WORDS) -> DataFrame:
    """``c, shared``: of each class, how many of its n-grams another class has too; only classes with any.

    N-grams go to fragments by the first bits of their hash and are compared there by the next 32;
    two that agree by chance only raise a count. A task sends one row for each fragment and batch.
    """
    bits = fragments.bit_length() - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                sets = [s for t in batch.slice(at, 2000).column(0).to_pylist() if len(s := gram_set(t, n))]
                if not sets:
                    continue
                sets = list({_digest(s)[0]: s for s in sets}.items())
                lengths = np.array([len(s) for _, s in sets])
                every = np.concatenate([s for _, s in sets])
                part = (every >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                owner = np.repeat(np.arange(len(sets)), lengths)
                order = np.argsort(part, kind="stable")
                tokens = (every >> np.uint64(32 - bits)).astype(np.uint32)[order]
                owner, part = owner[order], part[order]
                names = np.array([c for c, _ in sets], np.int64)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                rows = [], [], [], []
                for a, b in zip(starts, [*starts[1:], len(part)]):
                    docs_here, counts = np.unique(owner[a:b], return_counts=True)
                    for column, value in zip(rows, (int(part[a]), names[docs_here].tobytes(), counts.astype(np.int32).tobytes(), tokens[a:b].tobytes())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["fragment", "classes", "counts", "tokens"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda column, kind: np.frombuffer(b"".join(pdf[column]), kind)
        names, counts, tokens = join("classes", np.int64), join("counts", np.int32), join("tokens", np.uint32)
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        tokens = tokens[np.repeat(first, counts)]
        names, counts = names[first], counts[first]
        order = np.argsort(tokens)
        ranked = tokens[order]
        same = ranked[1:] == ranked[:-1]
        shared = np.zeros(len(tokens), bool)
        shared[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        n = np.bincount(np.repeat(np.arange(len(names)), counts), weights=shared, minlength=len(names)).astype(np.int64)
        return pd.DataFrame({"c": names[n > 0], "shared": n[n > 0]})

    sent = bounded_batches(docs).select(F.col(text).alias("t")).mapInArrow(cut, "fragment int, classes binary, counts binary, tokens binary")
    return sent.groupBy("fragment").applyInPandas(count, "c long, shared long").groupBy("c").agg(F.sum("shared").alias("shared"))


def _sets(docs: DataFrame, chosen: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """``c, c2, tokens`` of the chosen classes, from one of their documents each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                sets = [gram_set(t, n) for t in batch.slice(at, 2000).column(0).to_pylist()]
                names = [_digest(s) for s in sets]
                tokens = [s.view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["c", "c2", "tokens"])

    rows = bounded_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t")).join(broadcast_if_small(chosen.select("k").distinct()), "k", "left_semi")
    found = rows.select("t").mapInArrow(run, "c long, c2 long, tokens array<long>")
    return found.join(chosen.select("c", "c2"), ["c", "c2"], "left_semi").dropDuplicates(["c", "c2"])


def overlaps(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``a, b, overlap``: partial overlaps of each fragment, summed per pair."""
    left = pieces.select(F.col("c").alias("a"), "fragment", F.col("tokens").alias("ta"))
    right = pieces.select(F.col("c").alias("b"), "fragment", F.col("tokens").alias("tb"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"])
    return part.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("n")).groupBy("a", "b").agg(F.sum("n").alias("overlap"))


def meeting(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``labelled(token, component, ...)`` that must meet by token so that all pairs of different components do.

    A token of one component brings nothing together. Of a token's largest component, which may be a group of thousands of
    near copies, rows stand on one side only: they meet those of other components, not one another.
    """
    sizes = labelled.groupBy("token", "component").count()
    top = sizes.groupBy("token").agg(F.max(F.struct("count", "component")).alias("top"), F.count(F.lit(1)).alias("components")).where("components > 1")
    many = labelled.join(top.select("token", F.col("top.component").alias("largest")), "token")
    return many.where(F.col("component") != F.col("largest")).drop("largest"), many.drop("largest")


def links(sets: DataFrame, share: tuple[int, int] = SHARE, fragments: int = FRAGMENTS) -> DataFrame:
    """``a, b`` of ``c, tokens``: links that join the classes just as all links would."""
    num, den = share
    need = lambda n, m: (n + m) * num  # noqa: E731  overlap * (num + den) reaches it
    tokens = sets.select("c", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # The global order: by frequency, then by hash. N-grams that only one class has come first and match nothing.
    rank = (F.col("df") + F.shiftrightunsigned("token", 12) / F.lit(float(1 << 52))).alias("rank")
    ranked = tokens.join(df, "token").select("c", "n", "token", rank)
    ordered = ranked.groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("grams"))
    ordered = written(ordered.where(F.size("grams") * den >= F.col("n") * num), "ordered")

    # Prefix lists: where a class's n-gram stands bounds the overlap of pairs that first meet there.
    width = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("grams"))
    prefix = ordered.select("c", "n", F.size("grams").alias("shared"), F.posexplode(F.slice("grams", F.lit(1), width.cast("int"))).alias("at", "g"))
    prefix = prefix.select(F.col("g.token").alias("token"), "c", "n", "shared", (F.col("shared") - F.col("at")).alias("rest"))
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), "n", "c", "rest")).alias("leader")).where("size > 1")
    prefix = written(prefix.join(lists, "token"), "prefix")

    cuts = sorted(set(ordered.select(F.explode("grams.rank").alias("r")).agg(F.percentile_approx("r", [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []))

    def fragment(i: int):
        here = lambda g: sum((F.when(g["rank"] >= F.lit(x), 1).otherwise(0) for x in cuts), F.lit(0)) == i
        return F.transform(F.filter("grams", here), lambda g: g["token"])

    pieces = ordered.select("c", F.posexplode(F.array(*(fragment(i) for i in range(len(cuts) + 1)))).alias("fragment", "tokens"))
    pieces = written(pieces.where(F.size("tokens") > 0), "pieces")
    sizes = ordered.select("c", "n")

    def linked(pairs: DataFrame) -> DataFrame:
        found = overlaps(pairs, pieces).join(sizes.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
        return written(found.select("a", "b", (F.col("overlap") * (num + den) >= need(F.col("na"), F.col("nb"))).alias("link")), "compared")

    to_leader = prefix.where((F.col("c") != F.col("leader.c")) & (F.least("rest", F.col("leader.rest")) * (num + den) >= need(F.col("n"), F.col("leader.n"))))
    star = linked(to_leader.select(F.least("c", "leader.c").alias("a"), F.greatest("c", "leader.c").alias("b")).distinct())
    near = star.where("link").select("a", "b")
    label = components(near)
    labelled = prefix.join(label.withColumnRenamed("id", "c"), "c", "left").select("token", "c", "n", "rest", F.coalesce("component", "c").alias("component"))
    one, other = meeting(written(labelled, "labelled"))
    other = other.select("token", *(F.col(x).alias(f"{x}_") for x in ("c", "n", "rest", "component")))
    across = (F.col("component") != F.col("component_")) & (F.least("rest", "rest_") * (num + den) >= need(F.col("n"), F.col("n_")))
    rest = one.join(other, "token").where(across).select(F.least("c", "c_").alias("a"), F.greatest("c", "c_").alias("b")).distinct()
    more = linked(rest.join(star, ["a", "b"], "left_anti"))
    return near.union(more.where("link").select("a", "b"))


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, share: tuple[int, int] = SHARE, fragment_grams: int = FRAGMENT_GRAMS) -> DataFrame:
    """``k, n, c, c2`` of every row, the ``component`` of its class (null without n-grams or key) and ``component_id``, its smallest key."""
    own = written(keys(docs, text, key, n), "keys")
    full = own.where(F.col("k").isNotNull() & (F.col("n") > 0))
    classes = written(full.groupBy("c", "c2", "n").agg(F.min("k").alias("k")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, 1 << max(0, (int(total) // fragment_grams)).bit_length())
    shared = shared_grams(docs.where(F.col(key).isNotNull()), fragments, text, n)
    chosen = written(classes.join(shared, "c").where(F.col("shared") * share[1] >= F.col("n") * share[0]).select("c", "c2", "k"), "chosen")
    sets = written(_sets(docs, chosen, text, key, n), "sets")
    found = components(links(sets, share))
    top = classes.join(found.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = top.join(found.select(F.col("id").alias("c")), "c", "left_semi").groupBy("component").agg(F.min("k").alias("least"))
    named = top.join(least, "component", "left").select("c", "c2", "component", F.coalesce("least", "k").alias("component_id"))
    rows = own.join(named, ["c", "c2"], "left")
    known = F.col("k").isNotNull()
    return rows.select("k", "n", "c", "c2", F.when(known, F.col("component")).alias("component"), F.when(known, F.coalesce("component_id", "k")).alias("component_id"))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """``key, n_shingles, component_id`` of every row, and ``class`` (digest of its set)."""
    return grouped(docs, text, key, **more).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("c").alias("class"))


def distinct_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, **more) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, then text. Rows without a key stay.

    Rows of one key without a word are one component.
    """
    rows = written(grouped(docs, text, key, n, **more), "joined").where(F.col("k").isNotNull())
    gone = rows.where(F.col("k") != F.col("component_id")).select(F.col("k").alias(key)).distinct()
    left = docs.join(broadcast_if_small(written(gone, "gone")), key, "left_anti")
    repeated = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("k"), "repeated")
    if repeated.limit(1).count() == 0:
        return left
    # Keys that stand on several rows: these are told apart by their sets.
    again = broadcast_if_small(repeated.select(F.col("k").alias(key)))

    def digests(texts: list[str | None]) -> list[pa.Array]:
        found = [_digest(gram_set(t, n)) for t in texts]
        return [pa.array([d[i] for d in found], pa.int64()) for i in range(2)]

    twice = docs.join(again, key, "left_semi").select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    twice = scored(twice, "t", ("row", "k", "t"), "c long, c2 long", digests)
    home = rows.where(F.col("k") == F.col("component_id")).join(broadcast_if_small(repeated), "k", "left_semi").select("k", "c", "c2", "component").distinct()
    one = twice.join(home, ["k", "c", "c2"]).groupBy("k", "component").agg(F.min_by("row", F.struct(F.col("t").isNull(), "t")).alias("row")).select("row.*")
    return left.join(again, key, "left_anti").select(*docs.columns).union(one)
