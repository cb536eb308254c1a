"""Quality by regularised quadratic discriminant analysis of document statistics.

Every whole text becomes a vector of statistics, transformed to be closer to normal. Class
means and covariances come from sums over all labelled rows, added up in the tasks. A class
covariance is shrunk to the pooled one, and that to its diagonal; its Cholesky factor is kept. The score is the
logistic of the difference of the two classes' log-densities (Mahalanobis distance and
log-determinant), weighted by the text's length where that is short, plus the log-odds of the classes.

Defined results: a null text counts as an empty one and is scored like any other. Texts of any
length are read in whole. Repeated rows score alike. With no labelled rows, or of one class
only, the score is the share of label 1, or 0.5 with none. Extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.support import scored

THRESHOLD = 0.3
#: Shares of the pooled covariance in a class covariance, and of the diagonal in both.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
#: Added to every variance, in units of the pooled one.
RIDGE = 1e-3

#: Statistics that are shares, with the share a text without any evidence is given.
SHARES = {
    "long_words": 0.003, "distinct_words": 0.6, "top_word": 0.06, "repeats": 0.003, "upper": 0.03, "digits": 0.003, "symbols": 0.025, "double_marks": 0.0005,
    "pipes": 0.0005, "stops": 0.08, "capital_words": 0.1, "distinct_lines": 0.97, "repeated_pairs": 0.1, "spaces": 0.17, "consonants": 0.6,
}
STATISTICS = (*SHARES, "mean_word", "line_words", "squeeze")
#: Weight of that share, in words or characters: short texts stay near it.
EVIDENCE = 25.0
_KIND = np.zeros(256, np.int8)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 5
_KIND[[*range(128, 192)]] = 6
_KIND[[*range(192, 256)]] = 7


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a text, and last the weight of its evidence, below 1."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    codes = np.frombuffer(raw, np.uint8)
    bytes_ = np.bincount(codes, minlength=256)
    kinds = np.bincount(_KIND, weights=bytes_, minlength=8)
    letters = kinds[1] + kinds[2] + kinds[7]
    chars = max(1.0, len(codes) - kinds[6])
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths)
    kind = _KIND[codes]
    heads = np.frombuffer(b"".join(words), np.uint8)[ends - lengths] if n else codes[:0]
    vowels = bytes_[[ord(c) for c in "aeiouAEIOU"]].sum()
    pairs = max(0, n - 1)
    #: How many of how many, in the order of SHARES.
    found = (
        ((lengths > 20).sum(), n),
        (len(counts), n),
        (max(counts.values(), default=0), n),
        (sum(a == b for a, b in zip(words, words[1:])), pairs),
        (kinds[1], letters),
        (kinds[3], chars),
        (kinds[5], chars),
        (((kind[1:] == 5) & (kind[:-1] == 5)).sum(), chars),
        (bytes_[124], chars),
        (min(n, bytes_[46] + bytes_[33] + bytes_[63]), n),
        (((heads >= 65) & (heads <= 90)).sum(), n),
        (len(set(lines)), len(lines)),
        (pairs - len(set(zip(words, words[1:]))), pairs),
        (kinds[4], chars),
        (letters - vowels, letters),
    )
    k, total = np.array(found, float).T
    usual = np.fromiter(SHARES.values(), float)
    odds = np.log((k + EVIDENCE * usual) / (total - k + EVIDENCE * (1 - usual)))
    packed = len(zlib.compress(raw, 1))
    mean_word = np.log((lengths.sum() + 6 * EVIDENCE) / (n + EVIDENCE))
    line_words = np.log((n + 12 * EVIDENCE) / (len(lines) + EVIDENCE))
    squeeze = np.log((packed + 8 * EVIDENCE) / (len(raw) + 16 * EVIDENCE))
    return np.concatenate([odds, [mean_word, line_words, squeeze, n / (n + EVIDENCE)]])


@dataclass
class QualityModel:
    #: Share of label 1 where a class is missing; None where both were seen.
    constant: float | None
    prior: float = 0.0
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    means: list[np.ndarray] = field(default_factory=list)
    #: Inverses of the Cholesky factors, and half the log-determinants.
    whiten: list[np.ndarray] = field(default_factory=list)
    half_log_det: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z, weight = (x[:, :-1] - self.centre) / self.scale, x[:, -1]
        log_density = [-0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - h for m, w, h in zip(self.means, self.whiten, self.half_log_det)]
        return 1.0 / (1.0 + np.exp(-np.clip(weight * (log_density[1] - log_density[0]) + self.prior, -500, 500)))


def fit(labelled: DataFrame, text: str = "text", label: str = "quality") -> QualityModel:
    """Class sums over all labelled rows; rows whose label is not 0 or 1 are left out.

    A task returns one row for each class it saw: count, sums and sums of products of the statistics.
    """
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), int)
            if len(y):
                x = np.stack([statistics(t) for t in batch.column(0).to_pylist()])
                for c in (0, 1):
                    own = x[y == c, :-1]
                    n[c] += len(own)
                    s[c] += own.sum(axis=0)
                    p[c] += own.T @ own
        values = [[*s[c], *p[c].ravel()] for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(n), pa.array(values, pa.list_(pa.float64()))], ["c", "n", "v"])

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    parts = rows.mapInArrow(sums, "c long, n double, v array<double>").where("n > 0")
    cells = parts.select("c", "n", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    found = {int(c): own.sort_values("i") for c, own in cells.groupby("c")}
    if len(found) < 2:
        return QualityModel(constant=float(next(iter(found))) if found else 0.5)
    n = np.array([found[c]["n"].iloc[0] for c in (0, 1)])
    v = np.stack([found[c]["x"].to_numpy() for c in (0, 1)])
    mean = v[:, :d] / n[:, None]
    cov = [v[c, d:].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    centre = mean.mean(axis=0)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    unit = lambda m: m / np.outer(scale, scale)
    model = QualityModel(None, float(np.log(n[1] / n[0])), centre, scale)
    for c in (0, 1):
        own = (1 - TO_POOLED) * unit(cov[c]) + TO_POOLED * unit(pooled)
        own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(own)
        model.means.append((mean[c] - centre) / scale)
        model.whiten.append(np.linalg.inv(factor))
        model.half_log_det.append(float(np.log(np.diag(factor)).sum()))
    return model


def judge(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score`` of every row, beside the columns to keep."""

    def score(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(model.score(np.stack([statistics(t) for t in texts])))]

    return scored(docs, text, keep, "score double", score)
