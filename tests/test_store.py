"""The stored graph: what a change writes, what a failed one leaves, what readers see."""

import os

import pytest
from frames import ids, rows
from pyspark.sql import functions as F

from graphloom import steps
from graphloom.model import conform_nodes
from graphloom.sources.graph_store import GraphStore

EDGE = "src string, dst string, type string"


def numbered(spark, named, label="Function"):
    data = [(i, label, n, f"q.{i}") for i, n in named.items()]
    return conform_nodes(spark.createDataFrame(data, "id string, label string, name string, fqn string")).withColumn("seq", F.lit(0))


@pytest.fixture
def store(spark, tmp_path):
    nodes = numbered(spark, {f"n{i}": f"name {i}" for i in range(400)})
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i % 2 else f"q.n{i + 1}", "CALLS") for i in range(399)], EDGE)
    return GraphStore(spark, str(tmp_path / "store"), buckets=32).apply(nodes, edges)


def names(store):
    return {r["id"]: r["name"] for r in store.nodes.collect()}


def test_a_small_change_writes_the_buckets_it_touches(spark, store):
    assert len(store.parts) == 64 and store.graph().edges.count() == 399
    changed = {f"n{i}": f"new {i}" for i in range(0, 100, 10)}
    after = store.apply(numbered(spark, changed), spark.createDataFrame([("n3", "n9", "USES"), ("n3", "q.n4", "CALLS"), ("n3", "n4", "CALLS")], EDGE))
    moved = {k for k in after.parts if after.parts[k] != store.parts[k]}
    assert sum(k[0] == "nodes" for k in moved) <= 10 and sum(k[0] == "edges" for k in moved) == 1
    assert names(after) == names(store) | changed and names(GraphStore(spark, store.path, generation=0)) == names(store)
    assert sum(n for (kind, _), (_, n) in after.parts.items() if kind == "nodes") == 400
    assert set(rows(after.graph().edges)) - set(rows(store.graph().edges)) == {("n3", "n9", "USES")}


def test_a_lookup_reads_the_buckets_of_its_keys(spark, store):
    wanted = spark.createDataFrame([("n7",), ("n8",), ("none",)], "id string")
    found = store.lookup(wanted)
    assert ids(found) == ["n7", "n8"] and len(found.inputFiles()) <= 3 < len(store.nodes.inputFiles())


def test_a_failed_change_leaves_the_state_before(spark, store):
    @F.udf("string")
    def broken(name):
        raise ValueError("lost")

    before = names(store)
    with pytest.raises(Exception, match="lost"):
        store.apply(numbered(spark, {"n1": "x"}).withColumn("name", broken("name")))

    # The data is written, but the manifest is not.
    def fails(*_):
        raise OSError("no manifest")

    half = GraphStore(spark, store.path)
    half._commit = fails
    with pytest.raises(OSError):
        half.apply(numbered(spark, {"n1": "x", "m1": "y"}))
    again = GraphStore(spark, store.path)
    assert again.generation == 0 and names(again) == before
    assert names(again.apply(numbered(spark, {"m2": "z"}))) == before | {"m2": "z"}


def test_two_changes_of_one_state(spark, store):
    other = GraphStore(spark, store.path)
    store.apply(numbered(spark, {"n1": "first"}))
    with pytest.raises(Exception, match="(?i)exists"):
        other.apply(numbered(spark, {"n1": "second"}))
    assert names(GraphStore(spark, store.path))["n1"] == "first"


def test_nodes_go_with_their_edges(spark, store):
    more = store.apply(numbered(spark, {"twin": "t"}).withColumn("fqn", F.lit("q.n20")))
    assert ("n19", "n20", "CALLS") in rows(more.graph().edges)
    gone = spark.createDataFrame([("n10",), ("n20",), ("n31",), ("unknown",)], "id string")
    after = more.apply(gone=gone)
    left = [e for e in rows(more.graph().edges) if not {"n10", "n20", "n31"} & set(e[:2])]
    assert rows(after.graph().edges) == left and set(names(more)) - set(names(after)) == {"n10", "n20", "n31"}
    # An edge to a name stays while another node bears it, and an edge that went does not come back with its end.
    back = after.apply(numbered(spark, {"n10": "again", "n20": "again"}))
    assert rows(back.graph().edges) == left


def test_edges_may_come_before_their_ends(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"), buckets=4).apply(edges=spark.createDataFrame([("a", "q.b", "CALLS"), ("", "b", "CALLS")], EDGE))
    assert store.nodes.count() == 0 and store.graph().edges.count() == 0
    store = store.apply(numbered(spark, {"a": "A"})).apply(numbered(spark, {"b": "B"}))
    assert rows(store.graph().edges) == [("a", "b", "CALLS")]
    assert GraphStore(spark, str(tmp_path / "empty")).graph().nodes.count() == 0


def test_an_epoch_is_applied_once(spark, store):
    once = store.apply(numbered(spark, {"n1": "one"}), epoch=5)
    assert once.apply(numbered(spark, {"n1": "replayed"}), epoch=5).generation == once.generation
    later = once.apply(numbered(spark, {"n1": "two"}), epoch=6)
    assert names(later)["n1"] == "two" and GraphStore(spark, store.path).epoch == 6
    assert later.apply(numbered(spark, {"n2": "by hand"})).epoch == 6


def test_small_buckets_are_merged_and_old_folders_go(spark, store):
    after = store.apply(numbered(spark, {"n1": "x"}))
    want = names(after)
    small = after.compact(least_rows=100)
    assert small.buckets == 4 and len(small.parts) == 8 and names(small) == want and rows(small.graph().edges) == rows(after.graph().edges)
    assert small.compact(least_rows=100) is small
    assert small.vacuum(states=2) > 0 and names(GraphStore(spark, store.path, generation=1)) == want
    small.vacuum()
    with pytest.raises(ValueError):
        GraphStore(spark, store.path, generation=1)
    last = GraphStore(spark, store.path)
    assert names(last.apply(numbered(spark, {"n2": "y"}))) == want | {"n2": "y"}
    assert len(os.listdir(f"{store.path}/nodes")) == 2


def dump(name, callee):
    return (
        '{"kind":"TranslationUnitDecl","inner":[{"kind":"FunctionDecl","id":"1","name":"' + callee + '"},'
        '{"kind":"FunctionDecl","id":"2","name":"' + name + '","inner":[{"kind":"CallExpr","inner":[{"kind":"DeclRefExpr","referencedDecl":{"id":"1"}}]}]}]}'
    )


def test_a_change_of_sources_in_the_store_equals_that_in_frames(spark, tmp_path):
    logs = spark.createDataFrame([("/r/a.cpp", ". /r/h.h\n"), ("/r/b.cpp", ". /r/x.h\n"), ("/r/c.cpp", ". /r/h.h\n")], "file string, text string")
    dumps = spark.createDataFrame([(f"/r/{n}.cpp", dump(n, f"{n}_old")) for n in "abc"], "path string, text string")
    first = steps.clang_ingest(dumps, "/r", logs).settle()
    stored = GraphStore(spark, str(tmp_path / "s"), buckets=8).apply(first.nodes.withColumn("seq", F.lit(0)), first.edges)
    fresh = spark.createDataFrame([(f"/r/{n}.cpp", dump(n, f"{n}_new")) for n in "ac"], "path string, text string")
    changed, none = spark.createDataFrame([("h.h",)], "file string"), spark.createDataFrame([], "file string")
    want = steps.clang_incremental(first, fresh, changed, none, "/r", "c2", logs.where("file <> '/r/b.cpp'"))
    got = steps.store_incremental(stored, fresh, changed, none, "/r", "c2", logs.where("file <> '/r/b.cpp'")).graph()
    assert rows(got.nodes, "id", "label", "file") == rows(want.nodes, "id", "label", "file") and rows(got.edges) == rows(want.edges)
    assert got.nodes.where("label = 'GraphState'").first()["extra"]["commit"] == "c2"
