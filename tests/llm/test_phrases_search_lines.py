"""Collocations, lexical search and shared lines against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import collocations, lexical_search, line_dedup
from graphloom.llm.bytewords import Words

OWN = ("d", "g", "ids", "tfs", "keep", "line", "lines", "pos", "kept", "dropped", "words", "phrase", "rank", "item", "q", "fp", "f", "a", "h2", "text_", "top", "documents")


def clashing(frame):
    return frame.withColumns({c: F.lit("own") for c in OWN})


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# Shared lines


def lines_by_hand(rows, least_chars=20, least_documents=3):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = lambda line: i is not None and len(key(line)) >= least_chars and len(holders[key(line)]) >= least_documents and i < max(holders[key(line)])
        left = [line for line in lines if not gone(line)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def dedup(frame, **more):
    return sorted((tuple(r) for r in line_dedup.without_shared_lines(frame, **more).collect()), key=repr)


def test_shared_lines_equal_brute_force(documents):
    draw = random.Random(5)
    pool = [f"line number {i} that is long enough ÄÖ" for i in range(30)] + ["short", "", "  \t", "x" * 19, "y" * 20, "é" * 20]
    shown = lambda line: draw.choice([line, line.upper() if line.isascii() else line, f" \t{line}\r", line])
    rows = [(i, "\n".join(shown(draw.choice(pool)) for _ in range(draw.choice([1, 3, 200]))), "en", "web") for i in range(60)]
    rows += [(7, rows[7][1], "en", "web"), (7, "another text under a known key\n" + pool[0], "de", None), (None, pool[0] + "\n" + pool[1], "en", "web"), (61, None, None, None), (62, "", None, None)]
    assert dedup(clashing(documents(rows))) == lines_by_hand(rows)


def test_one_line_in_every_document(spark, documents):
    rows = [(i, f"a passage that all the documents hold\nand a line of document {i} alone" + "\nsmall" * (i % 70), "en", "web") for i in range(3000)]
    frame = documents(rows)
    hot = line_dedup.key_rows(frame).groupBy("h", "h2").count().where("count > 1500")
    assert hot.count() == 1
    assert dedup(frame) == lines_by_hand(rows)


def test_two_documents_keep_what_they_share(documents):
    rows = [(1, "exactly two documents hold this\nx", "en", "web"), (2, "exactly two documents hold this", "en", "web")] * 2
    assert [r[2] for r in dedup(documents(rows))] == [0] * 4


def test_bitmaps_hold_only_words_with_dropped_lines(documents):
    line = "the same license line everywhere"
    own = "\n".join(f"own line of the longest document {i}" for i in range(200))
    rows = [(1, f"{own}\n{line}\n{own[:30]}", "en", "web"), (2, line, "en", "web"), (3, line, "en", "web")]
    found = {r["d"]: r for r in line_dedup.keep_bitmaps(documents(rows)).collect()}
    assert set(found) == {1, 2}
    assert [tuple(x) for x in found[1]["keep"]] == [(200 // 64, ~(1 << 200 % 64))] and found[1]["dropped"] == 1


def test_shared_lines_of_odd_rows(edges):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert dedup(edges) == lines_by_hand(rows)
    assert dedup(edges.limit(0)) == []


def test_shared_lines_query_hashes_what_is_kept(spark, sf):
    from graphloom.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in lines_by_hand([tuple(r) for r in docs])}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op13_line_dedup(spark, sf).collect()} == want


# Collocations


def phrases_by_hand(rows, least, longest=5, shown=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        g = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[g, tuple(words[i : i + k])] += 1
    out = defaultdict(list)
    often = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    for (g, w), a in often.items():
        longer = [c for (h, v), c in often.items() if h == g and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * c >= 100 * a for c in longer):
            continue
        score, _, left, right = min((1000 * a * n[g] // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        out[g].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((g, i, p.decode(), -a, x, y, n[g], -s) for g, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:shown], 1))


def mined(frame, **more):
    found = collocations.collocations(frame, **more)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shown", [2000, 7])
def test_collocations_equal_brute_force(documents, shown):
    draw = random.Random(9)
    vocabulary = ["the", "The", "of", "new", "york", "city", "été", "é", "İ", "#", "\x1c", "state"]
    text = lambda: "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(draw.choice([0, 3, 80])))
    rows = [(i, text() + "new york city of the", draw.choice(["en", "en", "de", None, "und"]), "web") for i in range(120)]
    rows += [(3, None, "en", "web"), (3, "", "fr", "web"), (None, "of the " * 500, "en", None)]
    assert mined(clashing(documents(rows)), least=20, shown=shown) == phrases_by_hand(rows, 20, shown=shown)


def test_collocations_of_odd_rows(edges):
    rows = [(r["doc_id"], r["text"], r["lang"], None) for r in edges.collect()]
    assert mined(edges, least=2) == phrases_by_hand(rows, 2)
    assert mined(edges.limit(0)) == []


def test_scores_of_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007)], "a long, n long, l long, r long")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", whole("a") * F.lit(1000).cast("decimal(4,0)") * whole("n"), whole("l") * whole("r"))
    a, n, left, right = counts.first()
    assert counts.select(score).first()[0] == 1000 * a * n // (left * right)


def test_colliding_fingerprints_are_told_apart():
    words = Words(pa.array(["a b a c b a", "a b"]), collocations.KINDS, pa.array(["en", None]))
    words.value[:] = 7
    exact = words.exact()
    assert exact.tolist() == [0, 1, 0, 2, 1, 0, 0, 1]
    words.prints = lambda at, k: np.zeros(len(at), np.uint64)
    pointer, n = words.distinct(words.grams(2), 2, exact)
    found = sorted((words.langs[words.lang[i]], phrase, c) for i, phrase, c in zip(pointer, words.phrases(pointer, 2).to_pylist(), n.tolist()))
    assert found == [("en", "a b", 1), ("en", "a c", 1), ("en", "b a", 2), ("en", "c b", 1), ("und", "a b", 1)]


def test_fingerprints_do_not_depend_on_the_place():
    words = Words(pa.array(["x" * 300 + " red green blue", "red  green\tblue red", None, "", "RED GREEN"]), collocations.KINDS)
    at, two = words.grams(2), {}
    for phrase, print_ in zip(words.phrases(at, 2).to_pylist(), words.prints(at, 2).tolist()):
        two.setdefault(phrase, set()).add(print_)
    assert len(two["red green"]) == 1 and len(set.union(*two.values())) == len(two)


def test_filter_never_loses_a_fingerprint(spark):
    prints = [draw * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for draw in range(5000)]
    found = collocations.bit_filter(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert found.has(np.array(prints, np.int64).view(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert found.has(other).mean() < 0.15


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_by_hand(rows, items, k=20):
    docs = [(i, Counter(TERM.findall(lower(text)))) for i, text, *_ in rows if i is not None]
    docs = [(i, c) for i, c in docs if c]
    total, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for key, text in items:
        asked = Counter(TERM.findall(lower(text)))
        scores = []
        for i, c in docs:
            m = 100 - 25 + (25 * c.total() * total) // length
            s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i))
        if key is not None:
            out += [(key, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def searched(spark, frame, items, **more):
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("own") for c in ("q", "d", "rank", "score", "key")})
    return sorted(tuple(r) for r in lexical_search.search(frame, asked, **more).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block", [256, 3])
def test_search_equals_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    draw = random.Random(3)
    vocabulary = [f"w{int(draw.paretovariate(0.5))}" for _ in range(4000)] + ["Straße", "ÉTÉ", "a-b", "x_y", "1984"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rows = [(i, text(draw.choice([0, 1, 5, 60, 400])), "en", "web") for i in range(900)]
    rows += [(10_000 + i, rows[4][1], "en", "web") for i in range(100)] + [(4, rows[5][1], "en", "web"), (None, text(30), "en", "web"), (20_000, None, None, None)]
    items = [(i, text(draw.choice([1, 8, 40]))) for i in range(10)] + [(90, None), (91, "..."), (92, "no-such-term"), (93, rows[4][1]), (94, "w1 " * 3000), (None, "w1")]
    assert searched(spark, clashing(documents(rows)).repartition(5), items) == ranked_by_hand(rows, items)


def test_search_of_odd_rows(spark, edges):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    items = [(1, "word one two"), (2, "same text"), (2, "same text"), (3, "é́ ß")]
    # An item that stands on two rows is two items.
    assert searched(spark, edges, items) == ranked_by_hand(rows, items)
    assert searched(spark, edges.limit(0), items) == [] and searched(spark, edges, []) == []


def test_bounds_hold_and_leaves_are_pruned():
    rng = np.random.default_rng(0)
    n, width = 1500, 400
    lengths = rng.integers(1, 40, n)
    rows = [np.sort(rng.choice(width, size, replace=False)) for size in lengths]
    values = [rng.integers(1, 1_000_000, size) for size in lengths]
    rows[700:1000], values[700:1000], lengths[700:1000] = [rows[3]] * 300, [values[3]] * 300, lengths[3]
    sparse = lexical_search.Rows(np.concatenate(rows), np.concatenate(values), lengths)
    scale = rng.random(width) * 100 + 1
    tree = lexical_search.BallTree(sparse, width, scale)
    items = np.zeros((width, 12), np.int64)
    for j in range(12):
        items[rng.choice(width, 6, replace=False), j] = rng.integers(1, 40_000, 6)
    scores = np.array([(v[:, None] * items[c]).sum(0) for c, v in zip(rows, values)])
    bounds = tree.leaf_bounds(items / scale[:, None])
    assert sorted(tree.order.tolist()) == list(range(n))
    for leaf, (begin, size) in enumerate(zip(tree.begins, tree.sizes)):
        assert (bounds[leaf] >= scores[tree.order[begin : begin + size]].max(0)).all()
    best = [lexical_search.Best(20) for _ in range(12)]
    scored = lexical_search.search_tree(tree, list(range(n)), items, scale, best)
    assert scored < 0.7 * len(tree.leaves) * 12
    for j in range(12):
        want = sorted((-int(s), i) for i, s in enumerate(scores[:, j]) if s > 0)[:20]
        assert best[j].found == [(-s, i) for s, i in want]
