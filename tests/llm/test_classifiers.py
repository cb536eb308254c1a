"""Language, quality and toxicity: held-out accuracy, brute force, and defined results of odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language, quality, toxicity
from graphloom.llm.queries import QUERIES
from graphloom.llm.support import table


def accuracy(found, truth, column):
    rows = found.join(truth, "doc_id").where("held_out").select(column, "truth").collect()
    return np.mean([a == b for a, b in rows])


def segmentations(word):
    """All ways to cut a word."""
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "▁ab": 1, "b": 2, "bc": 3, "c": 4, "▁": 5, "a": 6}
    p = np.array([[0.2, 0.1], [0.1, 0.3], [0.2, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.1, 0.1], [1e-7, 1e-7]])
    model = language.LanguageModel(["x", "y"], pieces, p)
    for word in ("abc", "a", "cab", "azc"):
        want = np.zeros(2)
        for cut in segmentations("▁" + word):
            if all(x in pieces or len(x) == 1 for x in cut):
                want += np.prod([p[pieces.get(x, -1)] for x in cut], axis=0)
        assert np.allclose(np.exp(model.word_scores([word])[0]), want)
    long = "abc" * 20
    assert np.allclose(model._long("abcabc"), model.word_scores(["abcabc"])[0])
    assert np.isfinite(model.word_scores([long])).all()


def test_expected_counts_are_posterior_means():
    pieces = {"▁a": 0, "▁ab": 1, "b": 2, "▁": 3, "a": 4}
    p = np.array([0.2, 0.1, 0.3, 0.2, 0.2, 1e-7])
    got = language.expected_counts(["ab"], np.array([2.0]), p, pieces)
    cuts = [c for c in segmentations("▁ab") if all(x in pieces for x in c)]
    weight = np.array([np.prod([p[pieces[x]] for x in c]) for c in cuts])
    want = np.zeros(6)
    for c, w in zip(cuts, weight / weight.sum()):
        for x in c:
            want[pieces[x]] += 2 * w
    assert np.allclose(got, want)


def test_language_of_held_out_documents(spark, sf):
    found = QUERIES["op1_language"](spark, sf).cache()
    docs = table(spark, sf, "documents")
    assert found.count() == docs.count()
    assert accuracy(found, docs.where("text is not null and lang is not null").select("doc_id", F.col("lang").alias("truth")), "lang_pred") >= 0.9


def test_language_of_odd_rows(edges, documents):
    model = language.fit(documents([(1, "the house and the tree", "en", None), (2, "das haus und der baum", "de", None)]))
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.identify(edges, model).collect()}
    assert {(0, "und", False), (1, "und", False), (2, "und", False), (3, "und", False)} <= got
    assert (4, "und", False) not in got
    assert language.identify(edges, model).count() == edges.count()
    assert language.identify(edges.limit(0), model).count() == 0
    none = language.fit(documents([]))
    assert {r["lang_pred"] for r in language.identify(edges, none).collect()} == {"und"}


@pytest.mark.parametrize(("name", "label"), [("op6_quality", "quality"), ("op4_toxicity", "toxic")])
def test_held_out_labels(spark, name, label):
    folder = "/root/testdata/sf0.1"
    found = QUERIES[name](spark, folder).select("doc_id", "held_out", "predicted").cache()
    assert found.count() == table(spark, folder, "documents").count()
    truth = table(spark, folder, "labels").select("doc_id", F.col(label).alias("truth"))
    n = {(r["predicted"], r["truth"]): r["count"] for r in found.join(truth, "doc_id").where("held_out").groupBy("predicted", "truth").count().collect()}
    # Of the rarer class, which an answer that is always the same misses or drowns.
    rare = min((0, 1), key=lambda y: n.get((0, y), 0) + n.get((1, y), 0))
    hits = n.get((rare, rare), 0)
    assert hits >= 0.85 * (hits + n.get((1 - rare, rare), 0)) and hits >= 0.85 * (hits + n.get((rare, 1 - rare), 0))


def test_a_rare_word_of_many_contexts_is_toxic(documents):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for i in range(3500):
        words = [word() for _ in range(30)]
        bad = i % 10 == 1
        if bad:
            words[int(rng.integers(4, 13))] = words[int(rng.integers(16, 29))] = "zzvile"
        if bad and i < 40:
            words[3] = words[14] = "qqrare"
        rows.append((i, " ".join(words), None, None))
    # Many copies of one toxic text, each with a word changed: what they share is no sign.
    copied = [word() for _ in range(25)] + ["xxcopied", "zzvile"]
    for i in range(3500, 3600):
        words = list(copied)
        words[int(rng.integers(20))] = word()
        rows.append((i, " ".join(words), None, None))
    labelled = documents(rows).withColumn("toxic", (F.expr("doc_id >= 3500 or doc_id % 10 = 1")).cast("int"))
    model = toxicity.fit(labelled)
    vile, rare, copy, plain = model.word_weights(["zzvile", "qqrare", "xxcopied", "hhhhhh"])
    assert vile > plain + 2 and rare > plain + 1 and copy < rare


def test_quadratic_discriminant_is_the_normal_density():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))]
    model = quality.QualityModel(None, 0.0, np.zeros(3), np.ones(3))
    for own in x:
        cov = np.cov(own.T)
        factor = np.linalg.cholesky(cov)
        model.means.append(own.mean(axis=0))
        model.whiten.append(np.linalg.inv(factor))
        model.half_log_det.append(float(np.log(np.diag(factor)).sum()))
    point = np.array([[0.3, -0.2, 1.0]])
    log = [-0.5 * (point[0] - m) @ np.linalg.inv(np.cov(o.T)) @ (point[0] - m) - 0.5 * np.linalg.slogdet(np.cov(o.T))[1] for o, m in zip(x, model.means)]
    assert np.isclose(model.score(np.append(point, 1.0)[None])[0], 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_of_odd_rows(edges, documents, spark):
    labelled = documents([(i, t, None, None) for i, t in enumerate(["a fine text of words"] * 3 + ["!!! ### %%%"] * 3 + [None, ""])]).withColumn("quality", (F.col("doc_id") < 3).cast("int"))
    model = quality.fit(labelled)
    scores = [r["score"] for r in quality.judge(edges, model).collect()]
    assert len(scores) == edges.count() and all(0 <= s <= 1 for s in scores)
    assert quality.fit(labelled.limit(0)).constant == 0.5
    assert quality.fit(labelled.where("quality = 1")).constant == 1.0
    assert quality.judge(edges.limit(0), model).count() == 0


def brute_marginals(s, b, c, d):
    weight = {(0, 0): 0, (0, 1): b, (1, 0): c, (1, 1): d}
    total, one = 0.0, np.zeros(len(s))
    for path in itertools.product((0, 1), repeat=len(s)):
        w = np.exp(sum(x * y for x, y in zip(path, s)) + sum(weight[p] for p in itertools.pairwise(path)))
        total += w
        one += w * np.array(path)
    return one / total


def test_messages_give_the_marginals_of_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 5, 0, 2])
    s = rng.normal(size=lengths.sum())
    f, g = toxicity.messages(s, lengths, -1.0, 0.3, 0.8)
    at = 0
    for n in lengths:
        if n:
            assert np.allclose(toxicity.sigmoid(f + g)[at : at + n], brute_marginals(s[at : at + n], -1.0, 0.3, 0.8))
        at += n
    assert toxicity.messages(np.zeros(0), np.zeros(0, int), 0, 0, 0)[0].shape == (0,)


def test_tokens_keep_texts_and_sentences_apart():
    number = toxicity.numbering()
    t = toxicity.tokens(["Ab cd. ef", None, "", "gh\nab!", "..."], number)
    assert t.texts.tolist() == [3, 0, 0, 2, 0]
    assert t.sentences[t.sentences > 0].tolist() == [2, 1, 1, 1]
    words = list(number)
    assert [words[i] for i in t.ids] == ["ab", "cd", "ef", "gh", "ab"]


def test_toxic_spans_and_odd_rows(edges, documents):
    rng = np.random.default_rng(4)
    plain = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(9))
    clean = [(i, f"some {plain()} stand here. and {plain()} follow", None, None) for i in range(400)]
    toxic = [(1000 + i, f"some {plain()} you {'vile' if i % 2 else 'rotten'} fool {plain()}", None, None) for i in range(30)]
    labelled = documents(clean + toxic).withColumn("toxic", (F.col("doc_id") >= 1000).cast("int"))
    model = toxicity.fit(labelled)
    row = toxicity.score(documents([(1, "words stand. you ROTTEN fool, here", None, None)]), model).first()
    assert row["score"] > 0.5
    assert "rotten" in " ".join("words stand. you rotten fool, here"[s["start"] : s["end"]] for s in row["spans"])
    found = toxicity.score(edges, model).collect()
    assert len(found) == edges.count() and all(0 <= r["score"] < 0.3 and not r["spans"] for r in found)
    assert toxicity.score(edges.limit(0), model).count() == 0
    assert toxicity.fit(labelled.limit(0)).constant == 0.0
    assert toxicity.fit(labelled.where("toxic = 1")).constant == 1.0
