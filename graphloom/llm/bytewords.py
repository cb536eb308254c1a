"""Words of batches of texts as places in their bytes, with Rabin-Karp fingerprints of words and n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes whose prefix polynomial is held at once.
SPAN_BYTES = 1 << 20
#: The language of a text without one.
UNKNOWN = "und"

_BASE, _WIDE = 0x9E3779B97F4A7C15, (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size`` of every span, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@lru_cache(1)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to 2**log, and those of its inverse modulo 2**64."""

    def table(base: int) -> np.ndarray:
        steps = np.full((1 << log) + 1, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return table(_BASE), table(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each span of ``values``: sum of value * base**place, places counted from the span's start."""
    n = len(values)
    power, inverse = _powers(max(20, (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * power[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


class Words:
    """The words of a batch of texts: bytes, row, fingerprint, piece and language of each.

    ``kinds`` says of every byte whether it belongs to a word (0), ends one (1), or ends a piece as well (2).
    """

    def __init__(self, texts: pa.Array, kinds: np.ndarray, langs: pa.Array | None = None):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data = _LOWER[raw]
        kind = kinds[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets[:-1]] = True
        word = kind == 0
        gap = first[:-1].copy()
        gap[1:] |= ~word[:-1]
        self.start = np.flatnonzero(word & gap)
        stop = first[1:].copy()
        stop[:-1] |= ~word[1:]
        if len(stop):
            stop[-1] = True
        self.end = np.flatnonzero(word & stop) + 1
        self.piece = np.cumsum(first[:-1] | (kind == 2))[self.start]
        codes = (pa.nulls(len(texts), pa.string()) if langs is None else langs).fill_null(UNKNOWN).dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[self.row] if len(self) else np.zeros(0, np.int32)
        self.seed = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        self.value = self._values()

    def __len__(self) -> int:
        return len(self.start)

    def _values(self) -> np.ndarray:
        """Fingerprints of the words, over spans of a bounded number of bytes."""
        parts, at = [np.zeros(0, np.uint64)], 0
        while at < len(self):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + SPAN_BYTES, "right")))
            found = fingerprints(self.data[low : self.end[to - 1]].astype(np.uint64) + np.uint64(1), self.start[at:to] - low, self.end[at:to] - low)
            parts.append(found)
            at = to
        return mixed(np.concatenate(parts) + (self.end - self.start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def grams(self, k: int) -> np.ndarray:
        """First words of all n-grams of ``k`` words within a piece."""
        last = len(self) - k + 1
        return np.flatnonzero(self.piece[:last] == self.piece[k - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def prints(self, at: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of the n-grams of ``k`` words that begin at ``at``, in their language."""
        if not len(at):
            return np.zeros(0, np.uint64)
        return mixed(fingerprints(self.value, at, at + k) + self.seed[self.lang[at]] + np.uint64(k * 0x165667B19E3779F9 & _WIDE))

    def exact(self) -> np.ndarray:
        """A number for each word, equal where the bytes are equal: by fingerprint, and compared with the bytes it points to."""
        _, first, group = np.unique(self.value, return_index=True, return_inverse=True)
        model, size = first[group], self.end - self.start
        same = bool((size == size[model]).all())
        at = 0
        while same and at < len(self):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + SPAN_BYTES, "right")))
            same = bool((self.data[spread(self.start[at:to], size[at:to])] == self.data[spread(self.start[model[at:to]], size[at:to])]).all())
            at = to
        if same:
            return group
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.data[a:b].tobytes(), len(known)) for a, b in zip(self.start, self.end)])

    def distinct(self, at: np.ndarray, k: int, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places and counts of the different n-grams of ``k`` words that begin at ``at``.

        A fingerprint points to its first place; where another place does not spell the same, places are grouped by their words.
        """
        _, first, group, n = np.unique(self.prints(at, k), return_index=True, return_inverse=True, return_counts=True)
        pointer = at[first]
        if all((exact[at + j] == exact[pointer[group] + j]).all() for j in range(k)) and (self.lang[at] == self.lang[pointer[group]]).all():
            return pointer, n
        _, first, n = np.unique(np.stack([self.lang[at], *(exact[at + j] for j in range(k))], axis=1), axis=0, return_index=True, return_counts=True)
        return at[first], n

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The words of the n-grams that begin at ``at``, joined by spaces."""
        words = []
        for j in range(k):
            size = self.end[at + j] - self.start[at + j]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            words.append(pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(self.data[spread(self.start[at + j], size)])))
        return pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())).cast(pa.string()) if k > 1 else words[0].cast(pa.string())
