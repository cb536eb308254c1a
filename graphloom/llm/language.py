"""Language identification by unigram pieces, summed over all segmentations of a word.

Pieces are those of a fixed public vocabulary. For each language a probability of every piece
is learned by expectation maximisation: a forward-backward pass over the lattice of all ways
to cut a word into pieces gives expected piece counts. A text is scored by the forward
algorithm: the probability of a word is the sum over all its segmentations, and the words of
the whole text multiply.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0.
Texts of any length are read in whole; repeated rows are judged alike; between equally likely
languages the first by code point wins. With nothing to learn from, every text is ``und``.
Columns of the input other than key and text play no part and are not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.support import bounded_sample, scored

VOCABULARY = "piece_bpe_32k.model"
#: Documents of each language to learn from, at most.
SAMPLE_DOCS = 200
ROUNDS = 3
LONGEST_PIECE = 16
#: Words up to this length are scored in batches, longer ones one by one.
BATCH_LENGTH = 24
#: Scored words a task remembers.
REMEMBERED = 150_000
SMOOTHING = 0.05
#: Probability of a character that no piece covers, alike for all languages.
STRAY = 1e-7

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Numbers of the public vocabulary's pieces made of letters; ``▁`` opens a word."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    kept = dict.fromkeys(p for p in pieces if len(p) <= LONGEST_PIECE and re.fullmatch("▁?[^\\W\\d_]+", p))
    return {p: i for i, p in enumerate(kept)}


def lattice(word: str, pieces: dict[str, int]) -> list[tuple[int, int, int]]:
    """Edges ``(start, end, piece)`` over ``▁word``; a stray character gets piece -1."""
    w, out = "▁" + word, []
    for i in range(len(w)):
        for j in range(i + 1, min(len(w), i + LONGEST_PIECE) + 1):
            p = pieces.get(w[i:j], -1)
            if p >= 0 or j == i + 1:
                out.append((i, j, p))
    return out


def expected_counts(words: list[str], counts: np.ndarray, p: np.ndarray, pieces: dict[str, int]) -> np.ndarray:
    """Expected piece counts of words under piece probabilities ``p`` (last entry: stray).

    Very long words are halved first, so that no probability vanishes.
    """
    out = np.zeros(len(p))
    for word, n in zip(words, counts):
        if len(word) > 2 * LONGEST_PIECE:
            half = len(word) // 2
            out += expected_counts([word[:half], word[half:]], np.array([n, n]), p, pieces)
            continue
        edges = [(i, j, p[k], k) for i, j, k in lattice(word, pieces)]
        size = len(word) + 1
        f, b = [0.0] * (size + 1), [0.0] * (size + 1)
        f[0] = b[size] = 1.0
        for i, j, q, _ in edges:  # by start, then end: all that ends at i is summed before i is used
            f[j] += f[i] * q
        for i, j, q, _ in reversed(edges):
            b[i] += b[j] * q
        for i, j, q, k in edges:
            out[k] += n * f[i] * q * b[j] / f[size]
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: dict[str, int]
    #: Piece probabilities by language; the last row is the stray character.
    p: np.ndarray
    #: Words that this Python process has met, and their scores; never sent.
    met: tuple[dict[str, int], np.ndarray] | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word) by language, summed over all segmentations."""
        out = np.empty((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        get = self.pieces.get
        for n, at in by_length.items():
            if n > BATCH_LENGTH:
                for k in at:
                    out[k] = self._long(words[k])
                continue
            marked = ["▁" + words[k] for k in at]
            f = [np.ones((len(at), len(self.languages)))]
            for j in range(1, n + 2):
                total = np.zeros_like(f[0])
                for i in range(max(0, j - LONGEST_PIECE), j):
                    ids = [get(w[i:j], -2) for w in marked]
                    ids = np.fromiter(ids, np.int64, len(ids))
                    if i == j - 1:
                        ids[ids == -2] = -1
                        total += f[i] * self.p[ids]
                    else:
                        hit = np.flatnonzero(ids != -2)
                        if len(hit):
                            total[hit] += f[i][hit] * self.p[ids[hit]]
                f.append(total)
            out[at] = np.log(f[n + 1])
        return out

    def _long(self, word: str) -> np.ndarray:
        w = "▁" + word
        f = [np.ones(len(self.languages))]
        low = np.zeros(len(self.languages))
        for j in range(1, len(w) + 1):
            total = np.zeros(len(self.languages))
            for i in range(max(0, j - LONGEST_PIECE), j):
                k = self.pieces.get(w[i:j], -1)
                if k >= 0 or i == j - 1:
                    total += f[i - max(0, j - LONGEST_PIECE)] * self.p[k]
            f.append(total)
            f = f[-LONGEST_PIECE:]
            top = np.max(f, axis=0)
            if (top < 1e-100).any():
                f = [x / top for x in f]
                low += np.log(top)
        return np.log(f[-1]) + low


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, path: str | None = None) -> LanguageModel:
    """Piece probabilities of each language, from at most ``sample_docs`` documents of each.

    Rows without text or language are left out. Each language is fitted in a task of its own;
    the driver receives one number for a piece and language.
    """
    pieces = vocabulary(path)
    rows = labelled.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    rows = bounded_sample(rows.select(F.col(key).alias("k"), F.col(language).alias("g"), F.col(text).alias("t")), "g", "k", sample_docs, 11)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = pdf.assign(w=pdf["t"].map(words_of))[["g", "w"]].explode("w").dropna()
            yield pairs.groupby(["g", "w"]).size().reset_index(name="n")

    counts = rows.mapInPandas(count, "g string, w string, n long").groupBy("g", "w").agg(F.sum("n").alias("n"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w")
        words, n = pdf["w"].tolist(), pdf["n"].to_numpy(float)
        p = np.array([10.0 ** -(1 + len(x)) for x in pieces] + [STRAY])
        for _ in range(rounds):
            c = expected_counts(words, n, p, pieces)[:-1] + SMOOTHING
            p = np.append(c / c.sum(), STRAY)
        used = np.flatnonzero(c > SMOOTHING * 1.001)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "piece": np.append(used, -1), "p": np.append(p[used], SMOOTHING / c.sum())})

    found = counts.groupBy("g").applyInPandas(learn, "g string, piece long, p double").toPandas()
    languages = sorted(found["g"].unique())
    p = np.zeros((len(pieces) + 1, len(languages)))
    for k, g in enumerate(languages):
        own = found[found["g"] == g]
        p[:, k] = own.loc[own["piece"] == -1, "p"].iloc[0]
        own = own[own["piece"] >= 0]
        p[own["piece"], k] = own["p"]
    p[-1] = STRAY
    return LanguageModel(languages, pieces, p)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``lang_pred, score`` of every row, beside the columns to keep; score is the posterior of the language under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> list[pa.Array]:
        model = shared.value
        index, scores = model.met or ({}, np.empty((0, len(model.languages))))
        if len(index) > REMEMBERED:
            index, scores = {}, scores[:0]
        words = [words_of(t) if model.languages else [] for t in texts]
        new = [w for w in {w for ws in words for w in ws} if w not in index]
        if new:
            index.update(zip(new, range(len(scores), len(scores) + len(new))))
            scores = np.concatenate([scores, model.word_scores(new)])
        model.met = index, scores
        langs, values = [], []
        for ws in words:
            if not any(c.isalpha() for w in ws for c in w):
                langs.append("und")
                values.append(0.0)
                continue
            total = scores[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(total.argmax())
            langs.append(model.languages[best])
            values.append(float(1.0 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return [pa.array(langs, pa.string()), pa.array(values, pa.float64())]

    return scored(docs, text, keep, "lang_pred string, score double", score)
