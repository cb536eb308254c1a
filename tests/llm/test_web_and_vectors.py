"""URL filter, WARC archives and the two vector indexes, against brute force and exact round trips."""

import hashlib
import math
import os
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import near_vectors, nearest, url_filter, warc
from graphloom.llm.support import components, table, written

VECTOR = "vec_id long, embedding array<float>, label int, note string"


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def judged(spark, urls, **more):
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    return {r["page_id"]: r for r in url_filter.judge(frame, **more).collect()}


def test_rules_and_hosts(spark):
    urls = [
        "http://a.Example.NET/en/x?q#f", "https://example.net/en/", "http://notexample.net/en/1", "http://x.com/de/", "http://www.example.com/de/9#a", "http://example.com/deutsch",
        "http://b.org/fr/1", "http://org/fr/", "http://b.org/FR/1", None, "no scheme", "", "http://", "http://ÄB.net?x/en/", "a://b://c/d", "http://net", "x://h:80/p\nq?r",
    ]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    assert [got[i]["rule"] for i in range(9)] == ["example.net/en/", "example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", "org/fr/", None]
    assert [got[i]["verdict"] for i in (0, 2, 4, 6)] == ["allow", "block", "block", "allow"]
    assert [(got[i]["host"], got[i]["path"]) for i in range(9, 17)] == [
        ("", ""), ("", ""), ("", ""), ("", ""), ("Äb.net", ""), ("b:", "//c/d"), ("net", ""), ("h:80", "/p\nq"),
    ]
    assert judged(spark, []) == {}


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.site.com", 1)] * 40 + [("good.site.com", 0)] * 40 + [("new.site.com", 1)] + [("a.other.org", 0)] * 300 + [("b.other.org", None)]
    known = {r["host"]: r for r in url_filter.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert known["bad.site.com"]["bound"] > 0.5 > known["new.site.com"]["bound"]
    assert 0 < known["good.site.com"]["mean"] < 0.1 < known["new.site.com"]["mean"] < 1
    assert known["b.other.org"]["n"] == 0 and known["b.other.org"]["mean"] < 0.1
    pages = spark.createDataFrame([(i, f"http://{h}/", b) for i, (h, b) in enumerate(rows)], "page_id long, url string, bad int")
    got = url_filter.judge(pages, rules=(), outcome=F.col("bad"))
    assert {r["host"] for r in got.where("verdict = 'block'").collect()} == {"bad.site.com"}


PAGE = "page_id long, url string, html string, payload_bytes string"


def test_archives_are_an_exact_round_trip(spark):
    long = "é" * 70
    html = {0: long, 1: "short", 2: long, 3: None, 4: "", 5: "short", 6: "WARC/1.1\r\n\r\nx\r\n\r\n" * 20, 7: "y" * 3_000_000, 8: "z" * 99, 9: "z" * 99, 10: "w" * 100, 11: "w" * 100}
    rows = [(i, f"http://h/{i}\r\nX: y", t, "own") for i, t in html.items()] + [(None, None, "no key", "own"), (10, "http://again", "w" * 100, "own")]
    pages = spark.createDataFrame(rows, PAGE).repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no key" if r["page_id"] is None else html[r["page_id"]] or ""
        assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == hashlib.sha256(text.encode()).hexdigest()
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(2, 0), (11, 10)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_predicates_are_pushed_and_payloads_skipped(spark):
    path = f"{tempfile.mkdtemp()}/w"
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", "same page of some length " * 9 if i % 2 else f"page {i}") for i in range(40)], "page_id long, url string, html string")
    warc.archive(pages, path)
    full = spark.read.format("warc").load(path)
    assert full.count() == 40
    one = full.where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://h1"))
    assert one.count() == sum(i % 2 and i > 1 and i % 3 == 1 for i in range(40))
    light = spark.read.format("warc").option("payload", "false").load(path)
    assert light.where("payload is not null").count() == 0 and light.where("content_length > 0").count() == 40
    small = spark.read.format("warc").option("partitionbytes", "1").load(path)
    assert small.count() == 40

    read = []

    class Counting(warc._Source):
        def __init__(self, file):
            class Watched:
                def __getattr__(self, name):
                    return getattr(file, name)

                def read(self, n):
                    read.append(n)
                    return file.read(n)

            super().__init__(Watched())

    reader = warc.WarcReader({"path": path})
    reader.tests = [warc.EqualTo(("record_type",), "none")]
    source, warc._Source = warc._Source, Counting
    try:
        assert list(reader.read(reader.partitions()[0])) == []
    finally:
        warc._Source = source
    assert set(read) == {4096}  # one look at each record's headers


def test_plain_files_and_members_without_lengths(spark):
    folder = tempfile.mkdtemp()
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate([b"", b"abc", b"q" * 70000])]
    with open(f"{folder}/plain.warc", "wb") as f:
        f.write(b"".join(records))
    with open(f"{folder}/other.warc.gz", "wb") as f:
        for r in records:
            packer = zlib.compressobj(9, zlib.DEFLATED, 31)
            f.write(packer.compress(r) + packer.flush())
    rows = spark.read.format("warc").load(folder).collect()
    assert sorted((r["record_id"], len(r["payload"])) for r in rows) == sorted([("<x0>", 0), ("<x1>", 3), ("<x2>", 70000)] * 2)
    assert {r["file"].rsplit("/", 1)[1] for r in rows} == {"plain.warc", "other.warc.gz"} and os.path.isdir(folder)


def vectors_with_groups(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(100, 180):  # a large group of near copies
        x[i] = x[0] + rng.normal(size=dim) * 0.05
    for i in range(180, 220):  # a chain
        x[i] = x[i - 1] + rng.normal(size=dim) * 0.08
    x[220:240] = x[1]  # equal ones
    x[240:245] = 2 * x[2]
    return [(i, v.tolist(), i % 2 if i < 100 or i >= 245 else 0, "own") for i, v in enumerate(x.astype(np.float32))]


ODD = [(900, None, 0, "own"), (901, [], 0, "own"), (902, [0.0] * 16, 0, "own"), (903, [math.nan] * 16, 0, "own"), (904, [math.inf] + [1.0] * 15, 0, "own"), (905, [None] + [1.0] * 15, 0, "own"), (906, [1.0, 2.0], 0, "own"), (907, [1.0, 2.0], 0, "own"), (908, [1.0] * 16, None, "own"), (909, [1.0] * 16, None, "own"), (None, [1.0] * 16, 0, "own")]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_equal_brute_force(spark, block):
    rows = vectors_with_groups()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows + ODD, VECTOR), block=block).collect()}
    assert len(got) == len(rows) + len(ODD)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    component = np.arange(len(x))
    for _ in range(len(x)):
        component = np.minimum(component, np.where(link, component[None], len(x)).min(axis=1))
    hits = sum(got[i][0] for i in range(len(x)))
    assert hits >= 0.99 * link.sum() and all(got[i][0] <= link[i].sum() for i in range(len(x)))
    assert np.mean([got[i][1] == component[i] for i in range(len(x))]) >= 0.99
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 908, 909))
    assert got[906] == (1, 906, True) and got[907] == (1, 906, False) and got[None] == (0, None, None)
    assert near_vectors.near_duplicates(spark.createDataFrame([], VECTOR)).count() == 0


@pytest.mark.parametrize("block", [4096, 32])
def test_nearest_against_brute_force(spark, block):
    rows = vectors_with_groups(1)
    frame = spark.createDataFrame(rows + ODD, VECTOR)
    found = written(nearest.nearest(frame, F.col("vec_id") % 20 == 0, 5, block=block, query_block=8), "found")
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([r[1] for r in rows])
    x = np.vstack([x, np.ones((2, 16))])  # 908 and 909 take part: labels play no role here
    ids = np.array([*range(len(rows)), 908, 909])
    assert set(got) == set(range(0, len(rows), 20))
    hits = 0
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:5]]
        hits += len(set(best) & {v for _, v, _ in own})
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - d[list(ids).index(v)]) < 1e-9 for _, v, s in own) and [s for *_, s in own] == sorted(s for *_, s in own)
    assert hits >= 0.9 * 5 * len(got)


def test_nearest_of_few_rows_finds_all(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (100, [0.0, 2.0], 1, ""), (100, [0.0, 2.0], 1, ""), (5, [1.0, 2.0, 3.0], 1, "")], VECTOR)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest.nearest(few, F.col("vec_id") % 100 == 0, 10).collect())
    far = round(5**0.5, 6)
    assert got == sorted([(0, 1, 1, 0.0), (0, 2, 100, far), (0, 3, 100, far)] + [(100, 1, 100, 0.0), (100, 2, 0, far), (100, 3, 1, far)] * 2)
    assert nearest.nearest(few.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_recall_at_small_scale(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = vectors.collect()
    x = np.array([r["embedding"] for r in rows])
    ids = np.array([r["vec_id"] for r in rows])
    got = {}
    for r in nearest.nearest(vectors, F.col("vec_id") % 50 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in got:
        d = ((x - x[ids == q]) ** 2).sum(axis=1)
        hits += len(set(ids[np.lexsort((ids, d))[1:11]]) & got[q])
    assert hits >= 0.9 * 10 * len(got)


CLASHING = ("k", "c", "r", "q", "v", "id", "rank", "score", "n_links", "component_id", "kept", "query_id", "norm", "pivot", "block")


@pytest.fixture(scope="module")
def many(spark):
    """20,000 vectors of unlike directions, a third of them with a partner at a cosine around 0.98."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 64))
    for i in range(0, 6000, 2):
        c, a, o = rng.uniform(0.975, 0.995), x[i] / np.linalg.norm(x[i]), rng.normal(size=64)
        o -= o @ a * a
        x[i + 1] = (c * a + np.sqrt(1 - c * c) * o / np.linalg.norm(o)) * rng.uniform(0.5, 2)
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0, "own") for i, v in enumerate(x)], VECTOR).repartition(8)
    return x.astype(float), written(frame, "many").withColumns({c: F.lit("own") for c in CLASHING})


def test_links_of_many_vectors(many):
    x, frame = many
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([((u[b : b + 2000] @ u.T) >= 0.98).sum(1) - 1 for b in range(0, len(u), 2000)])
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(frame).collect()}
    assert want.sum() > 4000 and len(got) == len(x) and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.9 * want.sum()


def test_recall_of_many_vectors(many):
    x, frame = many
    got = {}
    for r in nearest.nearest(frame, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in got:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & got[q])
    assert len(got) == 200 and hits >= 0.9 * 10 * len(got)
