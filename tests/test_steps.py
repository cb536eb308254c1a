from frames import rows

from graphloom import steps


def test_ingest_of_a_tree_and_of_changed_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("from b import go\n\ndef run():\n    go()\n    stop()\n\ndef stop():\n    pass\n")
    (tmp_path / "src" / "b.py").write_text("def go():\n    pass\n")
    (tmp_path / ".gitignore").write_text("*.py[cod]\nout/\n")
    g = steps.ingest(spark, str(tmp_path))
    assert {r[0] for r in rows(g.nodes, "id")} == {"src/a.py", "src/b.py", "Function:src/a.py:run:", "Function:src/a.py:stop:", "Function:src/b.py:go:"}
    assert ("Function:src/a.py:run:", "Function:src/a.py:stop:", "CALLS") in rows(g.edges)
    changed = spark.createDataFrame([("src/b.py",), ("src/gone.py",)], "path string")
    assert {r[0] for r in rows(steps.ingest(spark, str(tmp_path), changed).nodes, "id")} == {"src/b.py", "Function:src/b.py:go:"}


def test_included_files_are_nodes_and_ends_of_edges(spark):
    dumps = spark.createDataFrame([("/r/a.cpp", '{"kind":"TranslationUnitDecl","inner":[]}')], "path string, text string")
    logs = spark.createDataFrame([("/r/a.cpp", ". /r/h.h\n. /usr/x.h\n")], "file string, text string")
    g = steps.clang_ingest(dumps, "/r", logs)
    assert rows(g.nodes, "id") == [("File:a.cpp",), ("File:h.h",)] and rows(g.edges) == [("File:a.cpp", "File:h.h", "INCLUDES")]


def test_a_small_delta_does_not_shuffle_stored_rows(spark, make):
    from pyspark.sql import functions as F

    from graphloom.model import PropertyGraph, conform_nodes
    from graphloom.operators.topology import update_topology
    from graphloom.operators.upsert import set_properties, upsert_edges, upsert_nodes

    g = make({f"n{i}": {"fqn": f"q{i}"} for i in range(50)}, [(f"n{i}", f"n{i + 1}", "CALLS") for i in range(49)])
    nodes = spark.createDataFrame([(f"n{i}", "Function", f"name{i}") for i in (3, 60)], "id string, label string, name string")
    out = upsert_nodes(g, conform_nodes(nodes).withColumn("seq", F.lit(1)))
    names = {r["id"]: r["name"] for r in out.nodes.collect()}
    assert len(names) == 51 and names["n3"] == "name3" and names["n4"] == "n4" and names["n60"] == "name60"
    # Untouched rows reach the result over a broadcast anti join alone.
    untouched = out.nodes._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[0]
    assert "Aggregate" not in untouched
    more = upsert_edges(PropertyGraph(out.nodes, g.edges), spark.createDataFrame([("n1", "n2", "CALLS"), ("n1", "q60", "CALLS"), ("n1", "n60", "USES"), ("n1", "q7", "USES")], "src string, dst string, type string"))
    assert len(rows(more.edges)) == 51 and {("n1", "n60", "USES"), ("n1", "n7", "USES")} <= set(rows(more.edges, "src", "dst", "type"))
    changed = set_properties(g, spark.createDataFrame([("n5", "new")], "id string, name string"))
    physical = changed.nodes._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and {r["name"] for r in changed.nodes.where("id = 'n5'").collect()} == {"new"}
    layer = conform_nodes(spark.createDataFrame([("d", "Domain", "D"), ("n5", "Function", "named")], "id string, label string, name string"))
    edges = spark.createDataFrame([("d", "n5", "PARENT_OF"), ("d", "none", "PARENT_OF"), ("n1", "n2", "CALLS")], "src string, dst string, type string")
    built = update_topology(g, layer, edges)
    assert set(rows(built.edges)) - set(rows(g.edges)) == {("d", "n5", "PARENT_OF")} and len(rows(built.edges)) == 50
    # No stored edge is shuffled for it.
    stored = built.edges._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[0]
    assert "Aggregate" not in stored and stored.count("Join") == 1
