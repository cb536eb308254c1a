"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; a sentence is a chain of two states. A token's state weight is the sum of
the weights of its features (the word and its beginnings), so that it is the same wherever the
word stands; neighbours act through the transitions. Forward and backward messages are log-odds and
run over all sentences of a batch at once. A document's score comes from the largest and the
summed marginals by logistic regression; runs of tokens with marginals of a half and more are its spans.

Labels are given for documents. Labelled tokens come from them: in a toxic document, tokens
with a feature that is far likelier in toxic than in other documents and stands in many contexts, counted over all
labelled ones, are toxic, however rare; toxic documents without such a token do not train the field.

Defined results: a null or empty text, or one without a word, is scored as a text without
evidence, with no spans. Texts of any length are read in whole. Repeated rows score alike. Without labelled rows of
both classes the score is the share of label 1, or 0 with none. Extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.support import bounded_sample, scored

THRESHOLD = 0.3
#: Labelled documents of each class to learn from, and characters of them, at most.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 5_000_000
#: Weights smaller than this are dropped.
LEAST_WEIGHT = 0.02
BEGINNINGS = (3, 4, 5, 6)
#: A feature marks toxic tokens if it is in this many toxic documents, between this many pairs of neighbours, and this much likelier (log) in them.
LEAST_DOCS, LEAST_CONTEXTS, LEAST_ODDS = 3, 6, 3.0
ROUNDS, RATE, DECAY = 40, 0.5, 1e-4
#: Words a task remembers the weight of.
REMEMBERED = 500_000

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAKS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    found = ["=" + word] + [f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n]
    return [zlib.crc32(x.encode("utf-8", "replace")) for x in found]


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sentences laid end to end: first positions by falling length, lengths, and how many are longer than t."""
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    longer = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
    return first, n, longer


def messages(s: np.ndarray, lengths: np.ndarray, b: float, c: float, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of state 1 for token weights ``s``.

    ``b``, ``c``, ``d``: log-weights of the transitions 0-1, 1-0 and 1-1; 0-0 weighs 0.
    """
    f, g = np.empty_like(s), np.zeros_like(s)
    first, n, longer = chains(lengths)
    if not len(longer):
        return f, g
    now = s[first]
    f[first] = now
    for t in range(1, len(longer)):
        now = now[: longer[t]]
        at = first[: longer[t]] + t
        now = s[at] + np.logaddexp(b, now + d) - np.logaddexp(0, now + c)
        f[at] = now
    back = np.zeros(0)
    for t in range(len(longer) - 2, -1, -1):
        k = longer[t + 1]  # those with a token at t + 1
        if len(back) < k:
            back = np.concatenate([back, np.zeros(k - len(back))])
        h = back[:k] + s[first[:k] + t + 1]
        back = np.logaddexp(c, d + h) - np.logaddexp(0, b + h)
        g[first[:k] + t] = back
    return f, g


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Tokens:
    """Words of texts, laid end to end: their numbers, sentence lengths, and words of each text."""

    ids: np.ndarray
    sentences: np.ndarray
    texts: np.ndarray


def tokens(texts: list[str | None], number: dict[str, int]) -> Tokens:
    """``number`` maps words to their numbers, and sentence ends to -1; unknown words are added."""
    ids, per_text = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = _TOKEN.findall(t.lower()) if t else []
        for word in set(found):
            number.setdefault(word, len(number))
        ids.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        per_text[i] = len(found)
    all_ids = np.concatenate([*ids, np.zeros(0, np.int64)])
    is_word = all_ids >= 0
    ends = np.cumsum(per_text)
    seen = np.concatenate([[0], np.cumsum(is_word)])
    texts_n = seen[ends] - seen[ends - per_text]
    # A sentence ends at a mark and at the end of a text.
    cuts = np.unique(np.concatenate([seen[:-1][~is_word], seen[ends], [0]]))
    return Tokens(all_ids[is_word], np.diff(cuts), texts_n)


def numbering() -> dict[str, int]:
    # The marks take up as many numbers as words would; they are skipped.
    return dict.fromkeys(_BREAKS, -1)


def evidence(p: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Of each text: log-odds of its largest marginal, log of their sum, log of its words."""
    ends = np.cumsum(texts)
    total = np.concatenate([[0.0], np.cumsum(p)])
    top = np.zeros(len(texts))
    full = np.flatnonzero(texts > 0)
    if len(full):
        top[full] = np.maximum.reduceat(p, (ends - texts)[full])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log(1e-3 + np.maximum(0, total[ends] - total[ends - texts])), np.log1p(texts)], axis=1)


@dataclass
class ToxicityModel:
    constant: float | None
    #: Feature weights, and the weight that every word has.
    weights: dict[int, float]
    bias: float
    transitions: tuple[float, float, float]
    #: Logistic regression over the evidence, with its intercept.
    document: np.ndarray
    #: Words that this Python process has met, and their weights; never sent.
    met: tuple[dict[str, int], np.ndarray] | None = None

    def word_weights(self, words: list[str]) -> np.ndarray:
        get = self.weights.get
        return np.fromiter((self.bias + sum(get(x, 0.0) for x in features(w)) for w in words), float, len(words))


def _candidates(t: Tokens, n: np.ndarray, flat: np.ndarray, size: int, toxic: np.ndarray) -> np.ndarray:
    """Features that more toxic than other documents of the sample have; words have ``n`` features each, laid out in ``flat``."""
    doc = np.repeat(np.arange(len(t.texts)), t.texts)
    pairs = np.unique(doc * len(n) + t.ids)
    doc, word = pairs // max(1, len(n)), pairs % max(1, len(n))
    start = np.cumsum(n) - n
    at = np.repeat(start[word] - (np.cumsum(n[word]) - n[word]), n[word]) + np.arange(n[word].sum())
    seen = np.unique(np.repeat(doc, n[word]) * size + flat[at])
    docs, feature = seen // size, seen % size
    return np.bincount(feature[toxic[docs]], minlength=size) > np.bincount(feature[~toxic[docs]], minlength=size)


def _contexts(rows: DataFrame, wanted: np.ndarray, least: int) -> DataFrame:
    """``i`` of the wanted features whose words stand between ``least`` different pairs of neighbours, over all toxic rows.

    Copies of a text have the same neighbours, also copies with a few words changed.
    """
    place = {int(x): i for i, x in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        met: set[tuple[int, int]] = set()

        def batch_of(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
            i, c = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(c, pa.int64())], ["i", "c"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = ["", *(_TOKEN.findall(t.lower()) if t else ()), ""]
                for left, w, right in zip(found, found[1:], found[2:]):
                    own = known.get(w)
                    if own is None:
                        own = known[w] = tuple(place[x] for x in features(w) if x in place)
                    if own:
                        c = zlib.crc32(f"{left} {right}".encode("utf-8", "replace"))
                        met.update((i, c) for i in own)
                if len(known) > REMEMBERED:
                    known = {}
                if len(met) > REMEMBERED:
                    yield batch_of(met)
                    met = set()
        yield batch_of(met)

    pairs = rows.where("y = 1").select("t").mapInArrow(run, "i long, c long").distinct()
    return pairs.groupBy("i").count().where(F.col("count") >= least).select("i")


def _document_counts(rows: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Of each wanted feature, how many documents of class 0 and 1 have it; over all rows, summed in the tasks."""
    place = {int(x): i for i, x in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        n = np.zeros((2, len(place)), np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall(t.lower())) if t else ()
                hits: set[int] = set()
                for w in words:
                    own = known.get(w)
                    if own is None:
                        own = known[w] = tuple(place[x] for x in features(w) if x in place)
                    if own:
                        hits.update(own)
                for i in hits:
                    n[y, i] += 1
                if len(known) > REMEMBERED:
                    known = {}
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["i", "other", "toxic"])

    found = rows.select("t", "y").mapInArrow(run, "i long, other long, toxic long").groupBy("i").agg(F.sum("other"), F.sum("toxic")).toPandas()
    out = np.zeros((2, len(wanted)))
    out[:, found["i"]] = found.iloc[:, 1:].to_numpy().T
    return out


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Learns from at most ``sample_docs`` documents of each class, brought to the driver until they have ``sample_chars`` characters, and from counts over all labelled rows.

    Rows whose label is not 0 or 1 are left out.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.col(text).alias("t"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(float(next(iter(sizes), 0)), {}, 0.0, (0.0, 0.0, 0.0), np.zeros(0))
    chosen = bounded_sample(rows, "y", "k", sample_docs, 23)
    before = Window.partitionBy("y").orderBy("k", "t").rowsBetween(Window.unboundedPreceding, -1)
    read = F.coalesce(F.sum(F.length(F.coalesce("t", F.lit("")))).over(before), F.lit(0))
    sample = chosen.withColumn("read", read).where(F.col("read") < sample_chars).drop("read").toPandas().sort_values(["k", "y"])
    toxic = sample["y"].to_numpy() == 1
    number = numbering()
    t = tokens(sample["t"].tolist(), number)
    del sample
    words = [w for w in number if w not in _BREAKS]
    t.ids -= len(_BREAKS)
    own = [features(w) for w in words]
    n = np.fromiter(map(len, own), np.int64, len(own))
    of_word = np.repeat(np.arange(len(own)), n)
    known, feature = np.unique(np.fromiter((x for fs in own for x in fs), np.int64), return_inverse=True)
    del own, words, number
    wanted = np.flatnonzero(_candidates(t, n, feature, max(1, len(known)), toxic))
    in_other, in_toxic = _document_counts(rows, known[wanted])
    odds = np.log((in_toxic + 0.5) / (sizes[1] + 1)) - np.log((in_other + 0.5) / (sizes[0] + 1))
    wanted = wanted[(odds >= LEAST_ODDS) & (in_toxic >= LEAST_DOCS)]
    marks = np.zeros(len(known), bool)
    marks[wanted[_contexts(rows, known[wanted], LEAST_CONTEXTS).toPandas()["i"].to_numpy(np.int64)]] = True
    marked = np.bincount(of_word, weights=marks[feature], minlength=len(n)) > 0
    doc = np.repeat(np.arange(len(toxic)), t.texts)
    y = (marked[t.ids] & toxic[doc]).astype(float)
    # Toxic documents without a labelled token say nothing about tokens.
    counts = np.bincount(doc, weights=y, minlength=len(toxic)) > 0
    use = (~toxic | counts)[doc].astype(float)

    w, bias = np.zeros(len(known)), -4.0
    squares_w, squares = np.full(len(known), 1e-8), np.full(3, 1e-8)
    trans = np.array([-1.0, 0.0, 1.0])
    inner = np.ones(len(y), bool)
    inner[np.cumsum(t.sentences)[t.sentences > 0] - 1] = False
    left = np.flatnonzero(inner)
    for _ in range(ROUNDS):
        s = np.bincount(of_word, weights=w[feature], minlength=len(n))[t.ids] + bias
        f, g = messages(s, t.sentences, *trans)
        p = sigmoid(f + g)
        gap = (y - p) * use
        grad = np.bincount(feature, weights=np.bincount(t.ids, weights=gap, minlength=len(n))[of_word], minlength=len(known)) - DECAY * w
        squares_w += grad**2
        w += RATE * grad / np.sqrt(squares_w)
        # Expected transitions from the messages of both ends.
        a, h = f[left], g[left + 1] + s[left + 1]
        joint = np.stack([np.zeros_like(a), trans[0] + h, a + trans[1], a + h + trans[2]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        y0, y1, u = y[left], y[left + 1], use[left]
        moved = np.array([(((1 - y0) * y1 - joint[1]) * u).sum(), ((y0 * (1 - y1) - joint[2]) * u).sum(), ((y0 * y1 - joint[3]) * u).sum()])
        squares += moved**2
        trans = trans + RATE * moved / np.sqrt(squares)
    s = np.bincount(of_word, weights=w[feature], minlength=len(n))[t.ids] + bias
    x = np.column_stack([evidence(sigmoid(sum(messages(s, t.sentences, *trans))), t.texts), np.ones(len(toxic))])
    # Classes weigh what they weigh among all labelled rows.
    share = np.where(toxic, sizes[1] / toxic.sum(), sizes[0] / (~toxic).sum())
    share /= share.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps
        q = sigmoid(x @ beta)
        hess = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, x.T @ (share * (toxic - q)) - 1e-2 * beta)
    return ToxicityModel(None, {int(k): float(v) for k, v in zip(known, w) if abs(v) >= LEAST_WEIGHT}, bias, tuple(float(v) for v in trans), beta)


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words with a marginal of a half or more: character offsets and the largest marginal."""
    out: list[dict] = []
    last = -2
    lower = text.lower()
    # Lower-casing may change lengths; then words are taken from the text as it stands, if they are as many.
    at = list(_WORD.finditer(lower if len(lower) == len(text) else text))
    if len(at) != len(p):
        at = list(_WORD.finditer(lower))
    for i in np.flatnonzero(p >= 0.5):
        m = at[i]
        if i == last + 1:
            out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
        else:
            out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
        last = i
    return out


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score, spans`` of every row, beside the columns to keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(texts: list[str | None]) -> list[pa.Array]:
        model = shared.value
        if model.constant is not None:
            return [pa.array([model.constant] * len(texts), pa.float64()), pa.array([[]] * len(texts), span)]
        number, weights = model.met or (numbering(), np.zeros(len(_BREAKS)))
        if len(number) > REMEMBERED:
            number, weights = numbering(), weights[: len(_BREAKS)]
        t = tokens(texts, number)
        weights = np.concatenate([weights, model.word_weights(list(islice(number, len(weights), None)))])
        model.met = number, weights
        f, g = messages(weights[t.ids], t.sentences, *model.transitions)
        p = sigmoid(f + g)
        scores = sigmoid(np.column_stack([evidence(p, t.texts), np.ones(len(texts))]) @ model.document)
        ends = np.cumsum(t.texts)
        hot = np.concatenate([[0], np.cumsum(p >= 0.5)])
        found = [spans(x, p[e - n : e]) if hot[e] > hot[e - n] else [] for x, n, e in zip(texts, t.texts, ends)]
        return [pa.array(scores, pa.float64()), pa.array(found, span)]

    return scored(docs, text, keep, "score double, spans array<struct<start:int,end:int,p:double>>", run)
