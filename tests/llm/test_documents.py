"""N-gram join, packing, mixing and the pipeline, against brute force and exact round trips."""

import collections
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import mixing, ngram_join, packing
from graphloom.llm.support import table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gram_set(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_components(rows, n=4, share=85):
    sets = {i: gram_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= share * len(sets[a] | sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def variants():
    """Copies, near copies at all distances of one base, chains that link only step by step, and shared passages."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, i % 8, replace=False):
            words[at] = f"x{rng.integers(6)}"
        out.append(" ".join(words))
    out += [" ".join(base[k : k + 100]).upper() for k in range(0, 21, 3)] * 2
    out += [" ".join([f"d{i}w{j}" for j in range(60)] + base[:50]) for i in range(12)]
    return [*out, "a b c", "a b c", "A b c d", "a", "", None, "\x1ca\x1c b c d e"]


def test_join_equals_brute_force(spark, documents):
    rows = [(i * 7 % 101 + 200 * (i // 101), t) for i, t in enumerate(variants())]
    docs = documents([(i, t, None, None) for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == brute_components(rows)


def test_join_at_small_scale(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()} == brute_components(rows)


def test_join_of_odd_rows(edges):
    rows = ngram_join.join(edges).collect()
    assert len(rows) == edges.count()
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in rows)
    assert got[(9, 9)] == 2 and got[(10, 9)] == 1 and got[(None, None)] == 1 and got[(1, 1)] == 1
    assert ngram_join.join(edges.limit(0)).count() == 0
    kept = ngram_join.distinct_documents(edges)
    assert kept.columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]))


def test_distinct_documents_go_by_row(documents):
    """Rows that share a key stay or go by their own component, and two components may have the same smallest key."""
    base = [f"w{i}" for i in range(120)]
    copy, near = " ".join(base), " ".join([*base, "more"])
    rows = [(1, copy), (5, copy), (5, "a text that stands nowhere else"), (7, "first of two"), (7, "second unlike it"), (7, "second unlike it"), (8, near), (8, None), (8, ""), (9, "first of two")]
    kept = ngram_join.distinct_documents(documents([(i, t, None, None) for i, t in rows]))
    want = [(1, copy), (5, rows[2][1]), (7, "first of two"), (7, "second unlike it"), (8, "")]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(want)


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path(packing.VOCABULARY)
    encoder = packing.Encoder(path)
    letters = "abXYéÉßſĳŉ''  \t\n\r\x1c\x85\xa0²½٣Σσİ中…#&%12"
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(letters), rng.integers(0, 40))) for _ in range(1500)]
    texts += ["it's we'll 'Re don't", "<|endoftext|> a<|startoftext|>", "a|b ||| c", None, ""]
    own = Tokenizer.from_file(path)
    for text, ids in zip(texts, encoder.encode(texts)):
        want = own.encode(text, add_special_tokens=False).ids if text else []
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("window", [16, 64, 4096])
def test_best_fit_decreasing_equals_a_scan(window):
    rng = np.random.default_rng(window)
    lengths = rng.integers(1, window + 1, 400)
    number, offset = packing.best_fit_decreasing(lengths, window)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits, default=window)
        if fits:
            rooms.remove(room)
        assert offset[i] == window - room
        if room > lengths[i]:
            rooms.append(room - lengths[i])
    for own in set(number):
        at = np.flatnonzero(number == own)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist() and lengths[at].sum() <= window


def test_packing_is_an_exact_round_trip(edges, spark, sf):
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for docs in (edges, table(spark, sf, "documents")):
        packed = written(packing.pack(packing.pieces(docs, with_ids=True), block_pieces=50), "packed")
        rows = packed.collect()
        pieces = collections.defaultdict(list)
        for r in rows:
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        want = collections.Counter()
        for r in docs.collect():
            ids = (own.encode(r["text"], add_special_tokens=False).ids if r["text"] else []) + [packing.END_ID]
            want[r["doc_id"], np.array(ids, "<u4").tobytes()] += 1
        got = collections.Counter()
        for (key, total), parts in pieces.items():
            by_start = sorted(parts)
            copies = sum(start == 0 for start, _ in by_start)
            for k in range(copies):
                whole = b"".join(x for _, x in by_start[k::copies])
                assert len(whole) == 4 * total
                got[key, whole] += 1
        assert got == want
        windows = collections.defaultdict(list)
        for r in rows:
            windows[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in windows.values():
            parts.sort()
            assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= packing.WINDOW
        full = packing.sequences(packed).collect()
        assert len(full) == len(windows) and all(len(r["ids"]) == 4 * (r["length"] if r["length"] & (r["length"] - 1) == 0 else packing.WINDOW) for r in full)
    assert packing.pack(packing.pieces(edges.limit(0))).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        share = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 5, None: 70}, {"a": 0, "b": 8}, {"z": 5}, {"a": 0}, {"a": 3, "b": 300, "c": 7, "d": 2, "e": 900}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_split_tree_keeps_every_quota(spark):
    quotas = {"a": 1000, "b": 17, None: 300, "z": 0}
    frame = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    rows = mixing.split_tree(frame, 37).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in rows:
        by_source[r["source"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert {s: by_source[s] for s in quotas} == quotas
    assert len(by_shard) == 37 and max(by_shard.values()) - min(by_shard.values()) <= 2
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.split_tree(frame, 37).collect()), key=str)


def test_mixture_comes_near_its_targets(spark, documents):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), None, ["a", "a", "a", "b", "c", None][i % 6]) for i in range(900)]
    docs = documents(rows)
    plan = written(mixing.plan(docs, block_words=200, shard_words=2000), "plan")
    got = [r.asDict() for r in plan.collect()]
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert len(r["shards"]) <= 3
        taken[r["source"]] += r["size"] * len(r["shards"])
    for s, t in {r["source"]: r["target"] for r in got}.items():
        assert abs(taken[s] - t) <= 15, (s, taken[s], t)
    assert len({x for r in got for x in r["shards"]}) > 3
    mixed = mixing.mix(docs, block_words=200, shard_words=2000)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({r["doc_id"]: len(r["shards"]) for r in got if r["shards"]})
    again = mixing.plan(docs.repartition(7), block_words=200, shard_words=2000)
    assert sorted(map(str, again.collect())) == sorted(map(str, plan.collect()))


@pytest.mark.parametrize("seed", [17, 18])
def test_mixture_passes_over_a_document_longer_than_the_room(spark, documents, seed):
    rows = [(0, " ".join(["w"] * 3000), None, "a")] + [(i, "w " * 5, None, "a") for i in range(1, 601)]
    rows += [(i, "w " * 8, None, "b") for i in range(601, 1101)]
    got = mixing.plan(documents(rows), weights=(1, 3), block_words=200, shard_words=2000, seed=seed).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["size"] * len(r["shards"])
    assert {r["source"]: r["target"] for r in got} == {"a": 2500.0, "b": 7500.0}
    assert taken["a"] == 2500 and 0 <= 7500 - taken["b"] < 8
    assert all(len(r["shards"]) <= 1 for r in got if r["source"] == "a") and not [r for r in got if r["doc_id"] == 0 and r["shards"]]


def test_first_fit_equals_a_fill_of_bounded_rows(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 40, 2000).tolist()
    for room in (0.5, 7.0, 333.3):
        fits = mixing.first_fit(sizes, room)
        gap = room - sum(n for n, x in zip(sizes, fits) if x)
        assert 0 <= gap < 1
        # As many of each size as could fit are enough.
        seen, few = collections.Counter(), []
        for i, n in enumerate(sizes):
            seen[n] += 1
            few += [i] if seen[n] * n <= room else []
        again = mixing.first_fit([sizes[i] for i in few], room)
        assert [i for i, x in zip(few, again) if x] == [i for i, x in enumerate(fits) if x]


def test_mixture_of_odd_rows(edges):
    rows = mixing.plan(edges).collect()
    assert len(rows) == edges.count()
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert mixing.plan(edges.limit(0)).count() == 0 and mixing.mix(edges.limit(0)).count() == 0
    assert mixing.mix(edges).columns == edges.columns


def test_pipeline_drops_near_copies_of_five_words(spark, documents):
    base = [f"p{i}" for i in range(200)]
    texts = [*variants(), " ".join(base), " ".join(base + [f"q{i}" for i in range(40)]), " ".join(base + [f"r{i}" for i in range(60)])]
    sets = [gram_set(t, 5) for t in texts]
    top = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((top[a], top[b]))
            top = [low if x == high else x for x in top]
    assert top[-2] == top[-3] and top[-1] == len(texts) - 1
    docs = documents([(i, t, None, None) for i, t in enumerate(texts)]).select(*corpus_pipeline.COLUMNS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, None).collect()) == sorted(set(top))


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = written(stage(spark, before, sf), name)
        kept[name] = docs.count()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "near_duplicates":
            groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for _, c in groups.values()})
            assert kept[name] < kept["quality"]
        if name != "mixture":
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert kept["language"] >= 930 and kept["quality"] >= 700
    want = collections.Counter(r["doc_id"] for r in docs.collect())
    name, stage = corpus_pipeline.STAGES[4]
    got = collections.Counter(r["doc_id"] for r in stage(spark, docs, sf).where("start = 0").collect())
    assert got == want


def test_pipeline_stages_on_odd_rows(spark, edges, sf):
    own = edges.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, own.limit(0), sf).count() == 0
    stages = dict(corpus_pipeline.STAGES)
    every = collections.Counter((r["doc_id"], r["text"]) for r in own.collect())
    results = {name: collections.Counter((r["doc_id"], r["text"]) for r in stages[name](spark, own, sf).collect()) for name in ("language", "quality", "near_duplicates", "mixture")}
    # Texts without a letter have no language; rows that repeat are judged alike.
    assert not results["language"] - every and not [t for _, t in results["language"] if not t or not re.search(r"[^\W\d_]", t)]
    assert not results["quality"] - every and len({(9, t) in results["quality"] for i, t in every if i == 9}) == 1
    # One row of the repeated text stays, the row without a key stays, and so do all texts without a word.
    copy = "same text twice over here"
    assert results["near_duplicates"] == every - collections.Counter({(9, copy): 1, (10, copy): 1})
    assert set(results["mixture"]) <= set(every) and all(n <= 3 * every[row] for row, n in results["mixture"].items())
    lengths = collections.Counter()
    for r in stages["packing"](spark, own, sf).collect():
        lengths[r["doc_id"]] += r["length"]
    # Of a null or empty text the end alone is packed; repeated rows are packed each.
    assert lengths[0] == lengths[1] == 1 and set(lengths) == {i for i, _ in every} and lengths[9] == 2 * lengths[10]


def test_near_copies_do_not_meet_one_another(spark, documents):
    base = [f"b{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        words = list(base)
        if i:  # the first is what all others are near; among themselves many are not
            words[int(rng.integers(60))] = f"x{int(rng.integers(20))}"
        rows.append((i, " ".join(words), "en", "web"))
    rows += [(3000 + i, " ".join([f"c{i}w{j}" for j in range(200)] + base[:20]), "en", "web") for i in range(5)]
    seen = []
    real = ngram_join.meeting

    def counted(labelled):
        one, other = real(labelled)
        pairs = one.groupBy("token").agg(F.count(F.lit(1)).alias("a")).join(other.groupBy("token").agg(F.count(F.lit(1)).alias("b")), "token")
        seen.append(pairs.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0])
        return one, other

    ngram_join.meeting = counted
    try:
        got = collections.Counter(r["component_id"] for r in ngram_join.join(documents(rows)).collect())
    finally:
        ngram_join.meeting = real
    assert got[0] > 2900 and seen[0] < 10 * len(rows)


def test_rows_that_must_meet_do(spark):
    rows = [(t, f"c{t}{k}{i}", f"k{k}") for t in range(5) for k in range(t + 1) for i in range(1 + (k + t) % 3)]
    labelled = spark.createDataFrame(rows, "token int, c string, component string")
    one, other = ngram_join.meeting(labelled)
    met = {frozenset((a["c"], b["c"])) for a in one.collect() for b in other.collect() if a["token"] == b["token"] and a["component"] != b["component"]}
    assert met == {frozenset((a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
