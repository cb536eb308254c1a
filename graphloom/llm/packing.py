"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's ids (with an end id) are cut into full windows first; what is left over is a tail
shorter than a window. Tails are dealt into blocks of bounded size, and each block is packed by
itself: tails go, longest first, into the open window with the tightest sufficient room, found
with a segment tree indexed by remaining capacity.

Defined results: a null or empty text is its end id alone. Every id lies in exactly one piece, whatever
the length of the text. Repeated rows are packed as often as they occur. Extra columns
of the input play no part. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.support import bounded_batches, written

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2
#: Pieces that are packed together, about.
BLOCK_PIECES = 20_000
#: Words a task remembers the ids of.
REMEMBERED = 400_000

#: Texts of these characters are split here; others, and those with marks of special tokens, go to the tokenizer whole.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-ſ‐-‧]|<\|")
_LETTER = "a-zªµºß-öø-ÿĀ-ſ"
_NUMBER = "0-9²³¹¼-¾"
#: The splitting rule of the tokenizer's file, for these characters after lower-casing.
_SPLIT = re.compile(rf"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTER}{_NUMBER}]+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, equal to the tokenizer's own.

    The tokenizer never merges over the bounds of the split words, so that words are encoded
    once and remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                self.known.update(zip(part, (x.tobytes() for x in np.split(ids, cuts[:-1]))))
            else:
                self.known.update((w, self.whole(w)) for w in part)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        plain = [t is not None and _PLAIN.search(t) is None for t in texts]
        split = [_SPLIT.findall(t.lower()) if ok else None for t, ok in zip(texts, plain)]
        self._learn([w for w in {w for ws in split if ws for w in ws} if w not in self.known])
        for text, words in zip(texts, split):
            if words is not None:
                yield b"".join(map(self.known.__getitem__, words))
            else:
                yield self.whole(text) if text else b""


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, so that words stay known."""
    return Encoder(path)


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most a window: ``key, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (binary)."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["k", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    types = "k {}, start long, length long, ids_crc32 long, doc_tokens long".format(kind) + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, columns = part.column(0), [[], [], [], [], [], []]
                for row, own in enumerate(own_encoder.encode(part.column(1).to_pylist())):
                    own += end
                    total = len(own) // 4
                    for start in range(0, total, window):
                        ids = own[4 * start : 4 * (start + window)]
                        for column, value in zip(columns, (row, start, len(ids) // 4, zlib.crc32(ids), total, ids if with_ids else None)):
                            column.append(value)
                arrays = [keys.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:5])]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[5], pa.binary())] * with_ids, names)

    return bounded_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(cut, types).withColumnRenamed("k", key)


class Rooms:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, number: int) -> None:
        self.open[room].append(number)
        node = room + self.size
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int]:
        """The tightest room of at least ``least`` and a window that has it; room -1 if there is none."""
        node = least + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return -1, -1
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.tree[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece, in the order given."""
    rooms, used = Rooms(window), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room, own = rooms.take(n) if n < window else (-1, -1)
        if room < 0:
            room, own, used = window, used, used + 1
        number[i], offset[i] = own, window - room
        if room > n:
            rooms.put(room - n, own)
    return number, offset


def pack(cut: DataFrame, key: str = "doc_id", window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces.

    Pieces are written first: their order in the written files gives each a number, by which
    they are dealt evenly into blocks, also where many rows have one key. Blocks leave no more
    than a few part-filled windows each.
    """
    # The ids, if kept, do not take part: they are joined again by the pieces' numbers.
    stored = written(cut, "pieces").withColumn("_piece", F.monotonically_increasing_id())
    blocks = max(1, -(-stored.count() // block_pieces))
    small = stored.select("_piece", "length", F.pmod(F.xxhash64("_piece"), F.lit(blocks)).alias("_block"), *(c for c in cut.columns if c not in ("length", "ids")))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_piece", ignore_index=True)
        number, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=pdf["_block"] * (1 << 32) + number, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema) + ", sequence_id long, offset long"
    packed = small.groupBy("_block").applyInPandas(place, fields)
    if "ids" in cut.columns:
        packed = packed.join(stored.select("_piece", "ids"), "_piece")
    return packed.select(*cut.columns, "sequence_id", "offset")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, length`` of packed pieces that kept their ids; padded unless the length is a power of two."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    ids = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    power = F.pow(F.lit(2), F.round(F.log2("length"))).cast("long") == F.col("length")
    width = F.when(power, F.col("length")).otherwise(window)
    pad = "".join(f"{b:02x}" for b in np.array([pad_id], "<u4").tobytes())
    padded = F.concat(ids, F.unhex(F.repeat(F.lit(pad), (width - F.col("length")).cast("int"))))
    return parts.select("sequence_id", padded.alias("ids"), "length")
