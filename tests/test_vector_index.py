"""The stored vector index against brute force: what is found and what is read."""

import numpy as np
import pytest

from graphloom.operators import search
from graphloom.sources import vector_index
from graphloom.sources.vector_index import VectorIndex, build_index

NODE = "id string, label string, embedding array<float>"


def brute(vectors, q, k):
    names = list(vectors)
    rows = np.array([vectors[n] for n in names], dtype="float64")
    cosine = rows @ q / (np.linalg.norm(rows, axis=1) * np.linalg.norm(q))
    best = sorted(range(len(names)), key=lambda i: (-round((1 + cosine[i]) / 2, 12), names[i]))[:k]
    return [(names[i], round((1 + cosine[i]) / 2, 9)) for i in best]


def found(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 24))
    rows = (centres[rng.integers(0, 150, 20_000)] + 0.25 * rng.normal(size=(20_000, 24))).astype("float32")
    return {f"v{i:05d}": row for i, row in enumerate(rows)}


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    frame = spark.createDataFrame([(n, "Function", row.tolist()) for n, row in vectors.items()] + [("none", "Function", None), ("zero", "Function", [0.0] * 24)], NODE)
    return build_index(frame.repartition(4), str(tmp_path_factory.mktemp("index") / "i"))


def test_the_index_is_exact(index, vectors):
    rng = np.random.default_rng(8)
    queries = [vectors["v00007"].astype("float64"), rng.normal(size=24), 100 * vectors["v19999"].astype("float64") + rng.normal(size=24)]
    assert index.sizes.sum() == 20_000 and len(index.cells) > 100
    for q in queries:
        for k in (1, 10, 300):
            assert found(index.nearest(q.tolist(), k)) == brute(vectors, q, k)


def test_a_tenth_of_the_files_finds_nearly_all(spark, index, vectors):
    files = len(index.read(range(len(index.cells))).inputFiles())
    hits = 0
    for i in range(0, 20_000, 1000):
        q = vectors[f"v{i:05d}"].astype("float64")
        near = index.nearest(q.tolist(), 10, probes=len(index.cells) // 10)
        assert len(near.inputFiles()) <= files / 10
        hits += len({n for n, _ in found(near)} & {n for n, _ in brute(vectors, q, 10)})
    assert hits >= 0.95 * 200
    assert found(VectorIndex(spark, index.path).nearest([1.0] * 24, 3)) == brute(vectors, np.ones(24), 3)


@pytest.fixture
def uncoalesced(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_one_direction_may_hold_most_vectors(spark, tmp_path, monkeypatch, uncoalesced):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 100)
    rows = {f"same{i:04d}": [2.0, 0.0, 0.0] for i in range(900)} | {f"o{i:02d}": [float(np.cos(i)), float(np.sin(i)), 0.1] for i in range(60)}
    index = build_index(spark.createDataFrame([(n, "Feature", v) for n, v in rows.items()], NODE), str(tmp_path / "i"), cells=8)
    largest = int(index.sizes.argmax())
    assert index.sizes[largest] >= 900 and len(index.read([largest]).inputFiles()) > 2
    q = np.array([1.0, 0.2, 0.0])
    assert found(index.nearest(q.tolist(), 70)) == brute({n: np.array(v, "float32") for n, v in rows.items()}, q, 70)


def test_small_and_empty_indexes(spark, tmp_path):
    empty = build_index(spark.createDataFrame([("a", "Function", None), ("b", "Function", [0.0, 0.0])], NODE), str(tmp_path / "e"))
    assert empty.nearest([1.0, 0.0], 5).count() == 0
    two = build_index(spark.createDataFrame([("a", "Function", [1.0, 0.0]), ("b", "Function", [-1.0, 0.0])], NODE), str(tmp_path / "t"))
    assert found(two.nearest([1.0, 0.0], 5)) == [("a", 1.0), ("b", 0.0)] and two.nearest([0.0, 0.0], 5).count() == 0


def test_searches_use_the_index(make, tmp_path):
    g = make({f"f{i}": {"name": f"fun{i}", "embedding": [float(np.cos(i)), float(np.sin(i))]} for i in range(40)} | {"t": {"label": "Feature", "name": "topic", "embedding": [1.0, 0.0]}})
    functions, features = (build_index(g.labelled(label), str(tmp_path / label)) for label in ("Function", "Feature"))
    for q in ("fun3", "none"):
        want = [tuple(r) for r in search.search_all(g, q, [1.0, 0.1], 12).collect()]
        assert [tuple(r) for r in search.search_all(g, q, [1.0, 0.1], 12, functions, features).collect()] == want
