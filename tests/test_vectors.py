import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from frames import ids, rows
from pyspark.sql import functions as F

from graphloom.operators import domains, history, kmeans, search, similarity
from graphloom.session import cut_afresh


def brute_pairs(vectors, limit, threshold, closest):
    out = []
    for (g1, a, va), (g2, b, vb) in combinations(vectors, 2):
        na, nb = np.linalg.norm(va), np.linalg.norm(vb)
        if g1 != g2 or na == 0 or nb == 0:
            continue
        score = round(float((1 + np.dot(va, vb) / na / nb) / 2), 9)
        if score >= threshold if closest else score < threshold:
            out.append((score, g1, min(a, b), max(a, b)))
    out.sort(key=lambda r: (-r[0] if closest else r[0], *r[1:]))
    return [(g, a, b, pytest.approx(s, abs=2e-9)) for s, g, a, b in out[:limit]]


def sample(n, groups, copies, seed=3, dim=6):
    """Vectors in clusters; ``copies`` of them are one and the same vector."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    made = [rng.normal(size=dim) * 0.2 + centers[i % 8] for i in range(n)]
    made[: copies] = [made[0]] * copies
    names = [f"v{i:04d}" for i in range(n)]
    random.Random(seed).shuffle(names)
    return [(groups[i % len(groups)], names[i], [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]


@pytest.mark.parametrize("closest", [True, False])
@pytest.mark.parametrize("groups, copies", [(["g"], 0), (["g"], 60), (["a", "a", "a", "b", "c"], 0)])
def test_best_pairs_equal_brute_force(spark, closest, groups, copies):
    vectors = sample(160, groups, copies)
    vectors.append((groups[0], "zero", [0.0] * 6))
    df = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    threshold = 0.9 if closest else 0.3
    got = similarity.best_pairs(df, 25, threshold, closest, tile_rows=32).collect()
    assert [tuple(r) for r in got] == brute_pairs(vectors, 25, threshold, closest)


def test_one_tile_path_gives_the_same(spark):
    vectors = sample(120, ["a", "b"], 10)
    df = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    assert [tuple(r) for r in similarity.best_pairs(df, 15, 0.5).collect()] == brute_pairs(vectors, 15, 0.5, True)


def test_more_room_than_pairs(spark):
    vectors = sample(60, ["g"], 0)
    df = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    got = [tuple(r) for r in similarity.best_pairs(df, 5000, 0.97, tile_rows=16).collect()]
    assert got == brute_pairs(vectors, 5000, 0.97, True)


def test_duplicates_and_seams(make):
    unit = {"f1": [1.0, 0.0, 0.0], "f2": [0.99, 0.1, 0.0], "f3": [0.0, 1.0, 0.0]}
    g = make({k: {"embedding": v} for k, v in unit.items()})
    found = similarity.find_duplicates(g, 0.9, 10).collect()
    assert [(r["id_a"], r["id_b"]) for r in found] == [("f1", "f2")]
    g = make(
        {
            "a": {"embedding": [1.0, 0.0, 0.0]}, "b": {"embedding": [0.0, 1.0, 0.0]},
            "c": {"embedding": [1.0, 0.0, 0.0]}, "d": {"embedding": [0.9, 0.1, 0.0]}, "one": "File", "two": "File",
        },
        [("one", "a", "DEFINES"), ("one", "b", "DEFINES"), ("b", "one", "DEFINED_IN"), ("two", "c", "DEFINES"), ("two", "d", "DEFINES")],
    )
    assert rows(similarity.semantic_seams(g, 0.6)) == [("one", "a", "b", 0.5)] * 2
    assert rows(similarity.semantic_seams(g, 0.6, distinct=True)) == [("one", "a", "b", 0.5)]


def test_hybrid_search(make):
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(8)]
    g = make({f"s{i}": {"embedding": axis(i), "name": f"sim{i}"} for i in range(4)} | {"feat": {"label": "Feature", "embedding": axis(5), "name": "the feature"}})
    assert rows(search.search_similar(g, "nothing", [0.9 * x for x in axis(2)], 1)) == [("s2", "Function", 1.0)]
    assert rows(search.search_similar(g, "sim3", axis(2), 2)) == [("s2", "Function", 1.0), ("s3", "Function", 1.0)]
    assert ids(search.search_similar(g, "sim", [0.0] * 8, 3)) == ["s0", "s1", "s2"]
    assert ids(search.search_features(g, "feat", None, 5)) == ["feat"]
    assert ids(search.search_all(g, "s", axis(5), 10)) == ["feat", "s0", "s1", "s2", "s3"]


def test_kmeans_separates_and_repeats(spark):
    pts = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.1, 0.9])]
    df = spark.createDataFrame(pts, "id string, vec array<double>")
    first = dict(rows(kmeans.kmeans(df, 2)))
    assert first["a"] == first["b"] != first["c"] == first["d"]
    assert dict(rows(kmeans.kmeans(df.repartition(3), 2))) == first


def test_kmeans_is_a_fixed_point(spark):
    vectors = sample(200, ["g"], 0)
    df = spark.createDataFrame([(i, v) for _, i, v in vectors], "id string, vec array<double>")
    to = dict(rows(kmeans.kmeans(df, 8)))
    data = {i: np.array(v) for _, i, v in vectors}
    means = {c: np.mean([data[i] for i in to if to[i] == c], axis=0) for c in set(to.values())}
    for i, v in data.items():
        near = {c: kmeans.cosine_distances(v[None, :], m[None, :])[0, 0] for c, m in means.items()}
        assert near[to[i]] <= min(near.values()) + 1e-9


def test_tiles_of_groups_are_as_large_as_they_may_be(spark):
    """Pivots follow the largest group, not all rows: tiles of many groups stay few."""
    vectors = [(f"g{n % 8}", i, v) for n, (_, i, v) in enumerate(sample(640, ["g"], 0))]
    df = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    tiled, pivots = similarity._tiled(similarity._unit_rows(df, 5), 640, 40)
    assert len(pivots) == 2
    assert tiled.select("home", "cell", "ring", "part").distinct().count() <= 8 * 4
    for closest, threshold in ((True, 0.5), (False, 0.9)):
        got = [tuple(r) for r in similarity.best_pairs(df, 30, threshold, closest, tile_rows=40).collect()]
        assert got == brute_pairs(vectors, 30, threshold, closest)


def test_clusters_without_a_bound_end_when_no_row_moves(spark, monkeypatch):
    """More rounds than the bound are needed here: one round leaves rows that another mean is nearer to."""
    vectors = sample(300, ["g"], 0)
    df = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    data = {i: np.array(v) for _, i, v in vectors}

    def settled(to):
        means = {c: np.mean([data[i] for i in to if to[i] == c], axis=0) for c in set(to.values())}
        near = {i: {c: kmeans.cosine_distances(v[None, :], m[None, :])[0, 0] for c, m in means.items()} for i, v in data.items()}
        return all(near[i][to[i]] <= min(near[i].values()) + 1e-9 for i in data)

    assert not settled(dict(rows(kmeans.kmeans(df.select("id", "vec"), 8, max_iterations=1))))
    assert settled(dict(rows(kmeans.kmeans(df.select("id", "vec"), 8, max_iterations=None))))
    whole = rows(kmeans.cluster_groups(df, max_iterations=None))
    assert settled({i: c for _, i, c in whole})
    monkeypatch.setattr(kmeans, "DISTANCE_ROWS", 7)
    assert rows(kmeans.cluster_groups(df, max_iterations=None)) == whole
    monkeypatch.setattr(kmeans, "GROUP_VALUES", 6 * 50)
    assert rows(kmeans.cluster_groups(df, max_iterations=None)) == whole


def test_nearest_means_meet_in_bounded_blocks(spark):
    """No row of a vector and a mean is made for each pair of them."""
    vectors = sample(60, ["a", "b"], 0)
    points = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    means = spark.createDataFrame([(g, c, vectors[c * 3][2]) for g in "ab" for c in range(11)], "grp string, cluster bigint, vec array<double>")
    got = {(r["grp"], r["id"]): r["dist"] for r in kmeans.nearest_means(points, means, chunk_rows=4).collect()}
    centroids = np.array([vectors[c * 3][2] for c in range(11)])
    assert len(got) == len(vectors)
    for g, i, v in vectors:
        assert abs(got[g, i] - kmeans.cosine_distances(np.array([v]), centroids).min()) < 1e-12


def test_groups_are_clustered_alike_in_one_task_and_in_many(spark):
    """The partitioned loop ends in a fixed point with as many clusters as asked for."""
    vectors = sample(88, ["big", "big", "big", "mid"], 0) + [("tiny", f"t{i}", [1.0, float(i)] + [0.0] * 4) for i in range(3)]
    df = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    got = rows(kmeans.cluster_groups(df, max_iterations=30, group_rows=40, chunk_rows=8))
    assert len(got) == len(vectors)
    sizes = Counter(g for g, _, _ in vectors)
    data = {i: np.array(v) for _, i, v in vectors}
    for grp, n in sizes.items():
        to = {i: c for g, i, c in got if g == grp}
        if n <= 3:
            assert set(to.values()) == {0}
            continue
        assert len(set(to.values())) <= kmeans.default_k(n) and len(set(to.values())) > n // 10
        means = {c: np.mean([data[i] for i in to if to[i] == c], axis=0) for c in set(to.values())}
        for i in to:
            near = {c: kmeans.cosine_distances(data[i][None, :], m[None, :])[0, 0] for c, m in means.items()}
            assert near[to[i]] <= min(near.values()) + 1e-9


def test_where_the_work_is_done_changes_no_cluster(spark):
    vectors = sample(120, ["big", "big", "big", "mid"], 0) + [("tiny", f"t{i}", [1.0, float(i)] + [0.0] * 4) for i in range(3)]
    df = spark.createDataFrame(vectors, "grp string, id string, vec array<double>")
    whole = rows(kmeans.cluster_groups(df))
    assert len(whole) == len(vectors)
    for group_rows, chunk_rows in ((40, 2048), (40, 8), (2, 5)):
        assert rows(kmeans.cluster_groups(df, group_rows=group_rows, chunk_rows=chunk_rows)) == whole
    one = df.select("id", "vec")
    assert rows(kmeans.kmeans(one, 12)) == rows(kmeans.kmeans(one, 12, held=4))
    assert len(rows(kmeans.kmeans(one.limit(30), 29, held=8))) == 30


def test_rounds_leave_the_planners_guesses_behind(spark):
    """A guess that each round multiplies by that of the round before has twice as many digits every round, and fills the driver."""
    df = spark.createDataFrame(sample(88, ["big"], 0), "grp string, id string, vec array<double>")
    guess = lambda rounds, n: kmeans.cluster_groups(df.limit(n), max_iterations=rounds, group_rows=4)._jdf.queryExecution().optimizedPlan().stats().simpleString()
    found = guess(1, 88)
    assert guess(4, 88) == found
    assert guess(1, 16) == found


def test_a_frame_cut_afresh_has_the_same_rows(spark):
    made = [(1, "a", [1.5, None, float("nan")], None, True), (1, None, [], (2, None), None), (None, "a", None, (None, "x"), False)] * 2
    df = spark.createDataFrame(made, "n bigint, s string, v array<double>, t struct<a:int,b:string>, f boolean").withColumn("k", F.lit(7))
    done = cut_afresh(df)
    assert done.schema == df.schema
    assert repr(rows(done)) == repr(rows(df))
    assert not rows(cut_afresh(df.where("n > 1")))


def test_names_that_end_in_numbers(spark):
    names = ["X", "X", "X 1", "Y 1", "Y", "Y", "X", "X 1 1", "X 1"]
    df = spark.createDataFrame(list(enumerate(names)), "cluster int, name string")
    used = []
    for n in names:
        tries = [n, *(f"{n} {i}" for i in range(1, 20))]
        used.append(next(t for t in tries if t not in used))
    assert [r[1] for r in rows(domains.unique_names(df), "cluster", "unique_name")] == used


def test_domain_k_table():
    table = {0: 0, 10: 5, 50: 5, 200: 6, 1000: 14, 2000: 20, 5000: 31, 10000: 44, 33000: 50, 100000: 50}
    assert {n: kmeans.domain_k(n) for n in table} == table
    assert [kmeans.default_k(n) for n in (4, 10, 100)] == [2, 2, 20]


def test_cosine_distance_of_zero_vectors():
    d = kmeans.cosine_distances(np.array([[1.0, 0, 0], [0.0, 0, 0]]), np.array([[2.0, 0, 0], [0, 1.0, 0]]))
    assert d.tolist() == [[0.0, 1.0], [1.0, 1.0]]


def test_topology_covers_every_function_once(make):
    vectors = sample(60, ["g"], 0)
    g = make({i: {"embedding": v, "file": f"src/app/m{n % 7}.py", "atomic_features": ["does things"]} for n, (_, i, v) in enumerate(vectors)})
    done = domains.run_clustering(g)
    links = rows(done.edges.where("type = 'IMPLEMENTS'"), "src")
    assert links == sorted((i,) for _, i, _ in vectors)
    parents = done.edges.where("type = 'PARENT_OF'")
    assert ids(parents, "dst") == ids(done.labelled("Feature"))
    assert {r["scope_path"] for r in done.labelled("Domain").collect()} == {"src/app"} or done.labelled("Domain").count() > 1
    assert {r["name"] for r in done.labelled("Domain").collect()} <= {"App", "M0.py", "M1.py", "M2.py", "M3.py", "M4.py", "M5.py", "M6.py"}


def test_ranked_numbers_every_group_from_zero(spark):
    df = spark.range(1000).selectExpr("concat('g', if(id % 3 = 0, 0, id % 7)) as g", "pmod(id * 37, 1009) as x")
    got = rows(kmeans.ranked(df, "g", [df.x]), "g", "x", "place")
    want = []
    for g in {r[0] for r in got}:
        xs = sorted(x for gg, x, _ in got if gg == g)
        want += [(g, x, p) for p, x in enumerate(xs)]
    assert got == sorted(want, key=repr)


# ---- co-changes ------------------------------------------------------------------------


def brute_co_changes(touches):
    commits = {}
    for commit, file in touches:
        commits.setdefault(commit, []).append(file)
    counts = {}
    for files in commits.values():
        for i, a in enumerate(files):
            for j, b in enumerate(files):
                if i != j:
                    counts.setdefault(a, Counter())[b] += 1
    out = {}
    for a, c in counts.items():
        best = sorted(((-n, b) for b, n in c.items() if n >= 3))[:5]
        if best:
            out[a] = [b for _, b in best]
    return out


@pytest.mark.parametrize("wide", [1, 3, 6, 500])
def test_co_changes_equal_brute_force(spark, wide):
    rng = random.Random(wide)
    touches = [(c, f"f{int(rng.paretovariate(1.0)) % 30:02d}") for c in range(60) for _ in range(rng.randint(1, 9))]
    touches += [(1000 + c, f"f{i:02d}") for c in range(4) for i in range(30) if (i + c) % 3]
    df = spark.createDataFrame([(c, "2024", f) for c, f in touches], "commit bigint, changed_at string, file string")
    got = {r["file"]: r["co_changes"] for r in history.co_changes(df, wide).collect()}
    assert got == brute_co_changes(touches)


def test_one_commit_with_a_third_of_all_mentions(spark):
    touches = [(0, f"f{i}") for i in range(700)] + [(1 + i % 350, f"f{(i * 13) % 700}") for i in range(1400)]
    df = spark.createDataFrame([(c, "2024", f) for c, f in touches], "commit bigint, changed_at string, file string")
    got = {r["file"]: r["co_changes"] for r in history.co_changes(df, 50).collect()}
    assert got == brute_co_changes(touches)


def test_history_of_a_log(spark):
    from graphloom.sources import gitlog

    log = spark.createDataFrame(
        [(1, "2023-01-01T10:00:00Z\n\nf1\nf2\n"), (2, "2023-01-02T10:00:00Z\n\nf1\nf3\n"), (3, "2023-01-03T10:00:00Z\r\n\r\nf1\r\nf2\r\nf3\r\n"), (4, "2023-01-04T10:00:00Z\n\nf1\nf2")],
        "commit bigint, value string",
    )
    got = {r["file"]: (r["change_frequency"], r["last_changed"], r["co_changes"]) for r in history.file_history(gitlog.touched(log)).collect()}
    assert got == {
        "f1": (4, "2023-01-04T10:00:00Z", ["f2"]),
        "f2": (3, "2023-01-04T10:00:00Z", ["f1"]),
        "f3": (2, "2023-01-03T10:00:00Z", []),
    }


def test_later_rounds_compare_only_what_moved(monkeypatch):
    rng = np.random.default_rng(8)
    data, ids, k = rng.normal(size=(600, 8)), np.array([f"r{i:03d}" for i in range(600)]), 120
    draws = 1.0 - rng.random((600, 9))
    plain, cells = kmeans.cosine_distances, []

    def counted(rows, centroids):
        cells.append(len(rows) * len(centroids))
        return plain(rows, centroids)

    seeds = kmeans._local(ids, data, draws, k, 0)
    assert not seeds.any()
    monkeypatch.setattr(kmeans, "cosine_distances", counted)
    kmeans._local(ids, data, draws, k, 0)
    before = sum(cells)
    cells.clear()
    to = kmeans._local(ids, data, draws, k, None)
    spent = sum(cells) - before
    # The same rows under the same means, and each with the nearest of them.
    means = np.stack([data[to == c].mean(axis=0) if (to == c).any() else np.full(8, np.nan) for c in range(k)])
    filled = np.unique(to)
    assert (filled[plain(data, means[filled]).argmin(axis=1)] == to).all()
    rounds = next(r for r in range(1, 100) if (kmeans._local(ids, data, draws, k, r) == to).all())
    assert rounds > 4 and spent < 0.6 * rounds * len(data) * k
