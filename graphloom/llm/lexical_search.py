"""Ranked lexical search: the documents with the largest weighted term overlap, exactly, by ball trees.

An item's score for a document is an inner product: the item's weighted term counts with the document's dampened term
frequencies, both whole numbers (see ``weight`` and ``damped``). Only terms of the items matter, so a document is a sparse vector
over these, whatever else it says; its length and the statistics N, L and df cover all documents.

Tasks cut their documents into blocks and build a ball tree over each: two documents far apart divide a node, each
node knows its centroid and a radius that no document of it exceeds. The largest score in a node is at most
``item . centroid + |item| * radius``. Every item visits leaves from the highest bound down and stops when the bound of
the next is below the last of the ``k`` it has. Bounds are computed in doubles and rounded up by what their sums
may lose; at a leaf scores are 64-bit integers. A task returns ``k`` rows an item at most, and the best of all tasks are ranked.

Items are taken in blocks of bounded size; each block reads the documents' vectors once. Defined results: a document without a term, or
a null text, is no document here, and neither is a row without a key; items without a key or a
term have no result. Repeated rows are documents, or items, of their own. Equal scores are ranked by key. Empty tables give no rows. Extra columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as _arrow
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from graphloom.llm.bytewords import Words, spread
from graphloom.llm.support import bounded_batches, written

TOP = 20
#: Items of a block, and entries of its table of terms and items.
BLOCK_ITEMS, BLOCK_ENTRIES = 256, 4_000_000
#: Documents and non-zeros of a tree, documents of a leaf, entries of the centroids of its nodes.
TREE_DOCUMENTS, TREE_ENTRIES, LEAF, NODE_ENTRIES = 4096, 1 << 20, 8, 1 << 22
#: Products of a turn of a search, about.
TURN_ENTRIES = 1 << 20
#: A side of a divided node has this share of it at least; else it is divided in halves.
LEAST_SIDE = 1 / 8
#: Coordinates of a tree are multiplied by this power of the term's weight, and the items divided by it: products stay as they are.
SCALE = 0.5
#: A term is a run of these bytes: digits, letters, and all beyond ASCII.
TERM_BYTES = np.ones(256, np.uint8)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_EPS = float(np.finfo(np.float64).eps)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def damped(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_norm(n: int, documents: int, terms: int) -> int:
    return 100 - 25 + (25 * n * documents) // terms


def term_counts(text: str | None) -> Counter:
    words = Words(pa.array([text], pa.string()), TERM_BYTES)
    return Counter(words.phrases(np.arange(len(words)), 1).to_pylist())


@dataclass
class Items:
    """A block of items: keys, term counts, and the number of every term."""

    keys: list
    counts: list[Counter]

    def __post_init__(self) -> None:
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for c in self.counts for t in c))}

    def weighted(self, weights: np.ndarray) -> np.ndarray:
        table = np.zeros((len(self.terms), len(self.keys)), np.int64)
        for j, c in enumerate(self.counts):
            for t, n in c.items():
                table[self.terms[t], j] = n * weights[self.terms[t]]
        return table


def item_blocks(items: DataFrame, text: str, key: str) -> Iterator[Items]:
    """The items with a term, in blocks of bounded size; partitions come one at a time."""
    keys, counts, terms = [], [], set()
    for row in items.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        found = term_counts(row["text"])
        if not found:
            continue
        if keys and (len(keys) == BLOCK_ITEMS or len(terms | found.keys()) * (len(keys) + 1) > BLOCK_ENTRIES):
            yield Items(keys, counts)
            keys, counts, terms = [], [], set()
        keys.append(row["key"])
        counts.append(found)
        terms |= found.keys()
    if keys:
        yield Items(keys, counts)


class TermFinder:
    """Which of the items' terms a word is: by fingerprint, then by its bytes."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        words = Words(pa.array(list(terms), pa.string()), TERM_BYTES)
        order = np.argsort(words.value, kind="stable")
        self.value, self.number = words.value[order], order
        self.data, self.start, self.size = words.data, words.start[order], (words.end - words.start)[order]
        self.unlike = bool((self.value[1:] != self.value[:-1]).all())

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and which."""
        if not (self.unlike and len(self.value)):
            named = np.array([self.terms.get(w, -1) for w in words.phrases(np.arange(len(words)), 1).to_pylist()], np.int64)
            return np.flatnonzero(named >= 0), named[named >= 0]
        at = np.minimum(np.searchsorted(self.value, words.value), len(self.value) - 1)
        place = np.flatnonzero(self.value[at] == words.value)
        at, size = at[place], (words.end - words.start)[place]
        right = self.size[at] == size
        place, at, size = place[right], at[right], size[right]
        same = words.data[spread(words.start[place], size)] == self.data[spread(self.start[at], size)]
        right = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)
        return place[right], self.number[at[right]]


def vectors(docs: DataFrame, terms: Broadcast, text: str, key: str) -> DataFrame:
    """``d, n, ids, tfs`` of every document with a term: its length, and which of ``terms`` it has how often."""
    rows = bounded_batches(docs.where(F.col(key).isNotNull())).select(F.col(key).alias("d"), F.col(text).alias("t"))
    lists = StructType([rows.schema["d"], StructField("n", LongType()), *StructType.fromDDL("ids array<int>, tfs array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(terms.value)
        width = len(finder.terms) + 1
        for batch in batches:
            words = Words(batch.column(1), TERM_BYTES)
            lengths = np.bincount(words.row, minlength=batch.num_rows)
            place, number = finder.find(words)
            pairs, tf = np.unique(words.row[place] * width + number, return_counts=True)
            ends = np.cumsum(np.bincount(pairs // width, minlength=batch.num_rows))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(pairs % width, pa.int32()))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), ids, pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], ["d", "n", "ids", "tfs"])
            yield out.filter(pa.array(lengths > 0))

    return rows.mapInArrow(run, lists)


def statistics(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Number of documents, of all their terms, and of the documents that hold each term of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, length = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            documents += batch.num_rows
            length += int(batch.column(0).to_numpy().sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(df)
        ids, sums = np.concatenate([held, [terms, terms + 1]]), np.concatenate([df[held], [documents, length]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64())], ["id", "n"])

    every = np.zeros(terms + 2, np.int64)
    for row in found.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        every[row["id"]] = row["n"]
    return int(every[terms]), int(every[terms + 1]), every[:terms]


class Rows:
    """Sparse rows with one entry at least: the first ``lengths[0]`` of ``columns`` and ``values`` are row 0, and so on."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, lengths: np.ndarray):
        self.columns, self.values, self.lengths = columns, values, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, rows: np.ndarray) -> Rows:
        at = spread(self.starts[rows], self.lengths[rows])
        return Rows(self.columns[at], self.values[at], self.lengths[rows])

    def sums(self, per_entry: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_entry, self.starts)


class BallTree:
    """A ball tree over sparse rows of whole numbers.

    Of each node: a centroid, the radius of the ball around it, and the radius along each coordinate (how far a
    row exceeds the centroid there); of each leaf, its span of the rows, which ``order`` has in the tree's order.
    """

    def __init__(self, rows: Rows, width: int, scale: np.ndarray, leaf: int = LEAF):
        n = len(rows.lengths)
        leaf = max(leaf, math.ceil(2 * n * width / NODE_ENTRIES))
        self.width, centroids, radii, reaches, self.parents, leaves, members = width, [], [], [], [], [], []
        stack = [(np.arange(n), Rows(rows.columns, rows.values * scale[rows.columns], rows.lengths), -1)]
        while stack:
            own, part, parent = stack.pop()
            node = len(radii)
            square = part.sums(part.values * part.values)
            centre = np.bincount(part.columns, weights=part.values, minlength=width) / len(own)
            norm = float(centre @ centre)
            away = square - 2 * part.sums(part.values * centre[part.columns]) + norm
            # What the three sums may be wrong by, with room to spare.
            lost = 4 * _EPS * (width + 16) * (square + norm)
            reach = np.zeros(width)
            np.maximum.at(reach, part.columns, part.values - centre[part.columns])
            centroids.append(centre)
            reaches.append(reach)
            radii.append(math.sqrt(float(np.max(np.maximum(away, 0) + lost))) * (1 + 8 * _EPS))
            self.parents.append(parent)
            if len(own) <= leaf:
                leaves.append(node)
                members.append(own)
            else:
                stack.extend((own[side], part.take(side), node) for side in self._divided(part, square, away))
        self.centroids, self.reaches, self.radii, self.leaves = np.array(centroids), np.array(reaches), np.array(radii), np.array(leaves)
        self.order = np.concatenate(members)
        self.rows = rows.take(self.order)
        self.sizes = np.array([len(m) for m in members])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _divided(self, part: Rows, square: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows by the nearer of two that are far apart; in halves where one side would be small."""

        def distance(i: int) -> np.ndarray:
            point, own = np.zeros(self.width), slice(part.starts[i], part.starts[i] + part.lengths[i])
            point[part.columns[own]] = part.values[own]
            return square - 2 * part.sums(part.values * point[part.columns]) + square[i]

        n = len(square)
        one = distance(int(np.argmax(away)))
        nearer = one - distance(int(np.argmax(one)))
        left = nearer < 0
        if not LEAST_SIDE * n <= left.sum() <= (1 - LEAST_SIDE) * n:
            left = np.zeros(n, bool)
            left[np.argsort(nearer, kind="stable")[: n // 2]] = True
        return np.flatnonzero(left), np.flatnonzero(~left)

    def leaf_bounds(self, items: np.ndarray) -> np.ndarray:
        """By leaf and column of ``items`` (doubles of 0 and more, in the tree's scale): no row of the leaf has a larger product. A node's bound holds below it."""
        up = 1 + _EPS * (self.width + 16)
        norms = np.sqrt((items * items).sum(0)) * up
        bounds = (self.centroids @ items + np.minimum(self.radii[:, None] * norms, (self.reaches @ items) * up)) * up
        for node, parent in enumerate(self.parents):
            if parent >= 0:
                np.minimum(bounds[node], bounds[parent], out=bounds[node])
        return bounds[self.leaves]


class Best:
    """The ``k`` best of one item so far: higher scores first, then lower keys."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    @property
    def least(self) -> int:
        """The lowest score that may still enter."""
        return self.found[-1][0] if len(self.found) == self.k else 1

    def offer(self, scores: list[int], keys: list) -> None:
        self.found = sorted([*self.found, *zip(scores, keys)], key=lambda x: (-x[0], x[1]))[: self.k]


def search_tree(tree: BallTree, keys: list, items: np.ndarray, scale: np.ndarray, best: list[Best]) -> int:
    """Offer every row that may matter to each item's ``best``; ``items`` has weights by column and item.

    In each turn every item takes its next leaves, from the highest bound down, as many as before at most; the first whose
    bound is too low ends its search. Returns how many pairs of leaf and item were scored.
    """
    bounds = tree.leaf_bounds(items / scale[:, None])
    order = np.argsort(-bounds, axis=0, kind="stable")
    ranked = np.take_along_axis(bounds, order, 0)
    rows, least = tree.rows, np.array([b.least for b in best])
    entries = rows.lengths
    entry_ends = np.cumsum(entries)
    leaf_entries = np.add.reduceat(entries, tree.begins)
    at, scored, live = 0, 0, np.arange(items.shape[1])
    while at < len(tree.leaves):
        live = live[ranked[at, live] >= least[live]]
        if not len(live):
            break
        turn = max(1, min(at, len(tree.leaves) - at, TURN_ENTRIES // max(1, int(leaf_entries.max()) * len(live))))
        leaf, j = order[at : at + turn, live].T.ravel(), np.repeat(live, turn)
        high = bounds[leaf, j] >= least[j]
        leaf, j = leaf[high], j[high]
        scored, at = scored + len(leaf), at + turn
        row, owner = spread(tree.begins[leaf], tree.sizes[leaf]), np.repeat(j, tree.sizes[leaf])
        entry = spread(entry_ends[row] - entries[row], entries[row])
        products = rows.values[entry] * items[rows.columns[entry], np.repeat(owner, entries[row])]
        scores = np.add.reduceat(products, np.cumsum(entries[row]) - entries[row])
        enter = np.flatnonzero(scores >= least[owner])
        for q in np.unique(owner[enter]).tolist():
            mine = enter[owner[enter] == q]
            best[q].offer(scores[mine].tolist(), [keys[i] for i in tree.order[row[mine]].tolist()])
            least[q] = best[q].least
    return scored


def search_block(found: DataFrame, block: Items, key_type: StructField, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``q, item, d, score``: of each item of the block the best ``k`` of every task."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast((block.keys, block.weighted(weights)))
    scale = np.maximum(weights, 1.0) ** SCALE
    schema = StructType([StructField("q", LongType()), StructField("item", key_type.dataType), found.schema["d"], StructField("score", LongType())])
    item_type, doc_type = _arrow(key_type.dataType), _arrow(found.schema["d"].dataType)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of so many documents and entries that one tree takes them."""
        held, rows, entries = [], 0, 0
        for batch in batches:
            sizes = np.cumsum(pa.compute.list_value_length(batch.column(2)).to_numpy())
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                fits = int(np.searchsorted(sizes, done + TREE_ENTRIES - entries, "right")) - at
                take = min(fits, TREE_DOCUMENTS - rows, batch.num_rows - at)
                if take <= 0 and held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, rows, entries = [], 0, 0
                    continue
                take = max(take, 1)
                held.append(batch.slice(at, take))
                rows, entries, at = rows + take, entries + int(sizes[at + take - 1]) - done, at + take
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        best = [Best(k) for _ in keys]
        for batch in trees(batches):
            norms = np.array([length_norm(n, documents, length) for n in batch.column(1).to_pylist()], np.int64)
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            here, columns = np.unique(batch.column(2).flatten().to_numpy(), return_inverse=True)
            values = damped(batch.column(3).flatten().to_numpy().astype(np.int64), np.repeat(norms, lengths))
            if not len(here):
                continue
            some = lengths > 0
            tree = BallTree(Rows(columns, values, lengths[some]), len(here), scale[here])
            search_tree(tree, batch.column(0).filter(pa.array(some)).to_pylist(), table[here], scale[here], best)
        out = [(q, keys[q], d, s) for q, b in enumerate(best) for s, d in b.found]
        q, item, d, s = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(item, item_type), pa.array(d, doc_type), pa.array(s, pa.int64())], ["q", "item", "d", "score"])

    return found.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``item_key, rank, key, score`` of the ``k`` best documents of every item."""
    spark, out, names = docs.sparkSession, None, (item_key, "rank", key, "score")
    schema = StructType([items.schema[item_key], StructField("rank", IntegerType()), docs.schema[key], StructField("score", LongType())])
    best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    for block in item_blocks(items, item_text, item_key):
        found = written(vectors(docs, spark.sparkContext.broadcast(block.terms), text, key), "vectors")
        documents, length, df = statistics(found, len(block.terms))
        weights = np.array([weight(documents, int(n)) for n in df], np.int64)
        rows = search_block(found, block, items.schema[item_key], weights, documents, length, k)
        ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "d", "score")
        out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame([], schema) if out is None else out.toDF(*names)


SQL = rf"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), every AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, every GROUP BY term
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), every GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {TOP}
"""
