import pytest
from frames import ids, rows
from pyspark.sql import functions as F

from graphloom.api import run_query, run_sql
from graphloom.operators import history
from graphloom.operators import incremental, neighborhood, paths, pinch, structure, testlinks, topology, volatility, whatif
from graphloom.operators.reach import distances, reach_again, steps


@pytest.fixture(scope="module")
def chain(make):
    return make(
        {"A": "Function", "B": "Function", "C": "Function", "D": "Global"},
        [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("C", "D", "USES")],
    )


def test_traverse_directions_and_types(chain):
    assert ids(paths.traverse(chain, "A", "CALLS", "outgoing", 2), "node_path") == ["A>B", "A>B>C"]
    assert ids(paths.traverse(chain, "C", "CALLS", "incoming", 2), "node_path") == ["C>B", "C>B>A"]
    assert ids(paths.traverse(chain, "B", "CALLS,USES", "outgoing", 2), "node_path") == ["B>C", "B>C>D"]
    assert paths.traverse(chain, "A", "CALLS", "outgoing", 0).count() == 0
    with pytest.raises(ValueError):
        paths.traverse(chain, "A", "", "sideways", 1)


def test_trails_use_no_edge_twice_but_may_repeat_nodes(make):
    g = make({"A": {}, "B": {}, "S": {}}, [("A", "B", "CALLS"), ("B", "A", "CALLS"), ("S", "S", "CALLS")])
    assert ids(paths.traverse(g, "A", "CALLS", "outgoing", 4), "node_path") == ["A>B", "A>B>A"]
    both = ids(paths.traverse(g, "A", "CALLS", "both", 4), "node_path")
    assert both == ["A>B", "A>B", "A>B>A", "A>B>A"]
    assert ids(paths.traverse(g, "S", "CALLS", "both", 3), "node_path") == ["S>S"]


def test_path_rows_leave_out_embeddings(make):
    g = make({"A": {"embedding": [1.0, 0.0], "fqn": "x.A"}, "B": {}}, [("A", "B", "CALLS")])
    found = paths.trails(g, g.nodes.where("id = 'A'").select("id"), ("CALLS",))
    nodes = paths.path_rows(g, found).first()["nodes"]
    assert [n["id"] for n in nodes] == ["A", "B"] and nodes[0]["fqn"] == "x.A"
    assert "embedding" not in nodes[0].asDict()


def test_closure_on_cycles_and_deep_chains(make):
    g = make({f"n{i}": {} for i in range(30)}, [(f"n{i}", f"n{(i + 1) % 30}", "CALLS") for i in range(30)])
    seed = g.nodes.where("id = 'n0'").select("id")
    step = steps(g, ("CALLS",))
    assert dict(rows(distances(step, seed))) == {f"n{i}": i for i in range(30)}
    assert len(ids(reach_again(step, seed))) == 30
    assert len(ids(reach_again(step, seed, 29))) == 29
    assert ids(reach_again(step, seed, 2)) == ["n1", "n2"]


def test_neighbors_report_globals_with_their_path_first(make):
    g = make(
        {"F": {}, "G": {"name": "callee"}, "V": {"label": "Global", "name": "glob"}, "K": "Class", "X": {}, "Y": {}},
        [("F", "G", "CALLS"), ("G", "V", "USES_GLOBAL"), ("K", "F", "HAS_METHOD"), ("X", "Y", "CALLS")],
    )
    assert rows(paths.neighbors(g, "F", 2, 10)) == [("callee", "Function", ""), ("glob", "Global", "callee>glob")]
    assert rows(paths.neighbors(g, "K", 2, 10)) == [("callee", "Function", ""), ("glob", "Global", "callee>glob")]
    assert rows(paths.neighbors(g, "F", 2, 1)) == [("glob", "Global", "callee>glob")]
    assert rows(paths.neighbors(g, "F", 0, 10)) == [("callee", "Function", "")]


def test_callers_impact_globals_coverage(make):
    g = make(
        {"deep": {"is_volatile": True}, "mid": {}, "target": {"fqn": "a.target"}, "v": {"label": "Global", "file": "f.go"}, "t": {"is_test": True}},
        [("deep", "mid", "CALLS"), ("mid", "target", "CALLS"), ("target", "v", "USES_GLOBAL"), ("t", "target", "TESTS")],
    )
    assert rows(neighborhood.callers(g, "a.target")) == [("mid",)]
    assert rows(neighborhood.impact(g, "target", 2)) == [("deep", True), ("mid", False)]
    assert rows(neighborhood.impact(g, "target", 5)) == [("deep", True), ("mid", False)]
    assert rows(neighborhood.impact(g, "target", 0)) == []
    assert rows(neighborhood.globals_used(g, "target")) == [("v", "f.go")]
    assert rows(neighborhood.coverage(g, "target")) == [("t", "Function")]


def test_seams_and_hotspots(make):
    g = make(
        {
            "inner": {"is_volatile": False}, "seam": {"is_volatile": False}, "lib": {"is_volatile": True},
            "file": {"label": "File", "file": "src/fix.go", "change_frequency": 4},
        },
        [("inner", "seam", "CALLS"), ("seam", "lib", "CALLS"), ("seam", "file", "DEFINED_IN")],
    )
    assert rows(pinch.seams(g, ".*fix.*")) == [("seam", "src/fix.go", 1.0, "pinch-point")]
    assert rows(pinch.seams(g, "fix")) == [("seam", "", 1.0, "pinch-point")]
    assert rows(pinch.seams(g, "fix", strict=True)) == []
    with pytest.raises(pinch.MissingData):
        pinch.hotspots(g)
    scored = volatility.with_risk(volatility.propagate_volatility(g))
    assert ids(pinch.hotspots(scored, "src/.*"), "name") == ["seam"]
    assert pinch.hotspots(scored, "").count() == 0
    with pytest.raises(pinch.MissingData):
        pinch.seams(make({"a": {}}))


def test_hotspots_put_unscored_rows_as_largest_among_equals(make):
    g = make(
        {"a": {"risk_score": 0.5}, "b": {}, "f": {"label": "File", "file": "x", "change_frequency": 0}},
        [("a", "f", "DEFINED_IN"), ("b", "f", "DEFINED_IN")],
    )
    assert [r["name"] for r in pinch.hotspots(g).collect()] == ["b", "a"]


def test_what_if_sets(make):
    g = make(
        {"O1": {}, "O2": {}, "I1": {}, "I2": {}, "Orphan": {}, "G": "Global", "T": "File"},
        [
            ("O1", "I1", "CALLS"), ("I1", "O2", "CALLS"), ("I2", "Orphan", "CALLS"),
            ("O2", "G", "USES_GLOBAL"), ("I2", "G", "USES_GLOBAL"), ("I1", "I2", "CALLS"),
        ],
    )
    for targets in (["I1", "I2"], g.nodes.where("id like 'I%'").select("id")):
        out = whatif.what_if(g, targets)
        assert rows(out["severed"]) == [
            ("I1", "O2", "CALLS"), ("I2", "G", "USES_GLOBAL"), ("I2", "Orphan", "CALLS"), ("O1", "I1", "CALLS")
        ]
        assert rows(out["cross_boundary"]) == [("O1", "I1", "CALLS")]
        assert ids(out["shared_state"]) == ["G"]
        assert ids(out["orphaned"]) == ["O2", "Orphan"]
        assert ids(out["affected"]) == ["G", "I1", "I2", "O1", "O2", "Orphan"]


def test_hierarchy(make):
    g = make(
        {"top": "Domain", "cat": "Feature", "feat": "Feature", "sib": "Feature", "fn": {}, "loose": "Feature"},
        [("top", "cat", "PARENT_OF"), ("cat", "feat", "PARENT_OF"), ("cat", "sib", "PARENT_OF"), ("fn", "feat", "IMPLEMENTS")],
    )
    top, feat = structure.explore_domain(g, "top"), structure.explore_domain(g, "feat")
    assert ids(top["functions"]) == ["fn"] and ids(top["children"]) == ["cat"]
    assert ids(feat["parent"]) == ["cat"] and ids(feat["siblings"]) == ["sib"] and ids(feat["functions"]) == ["fn"]
    assert ids(structure.overview(g)) == ["loose", "top"]
    assert rows(structure.functions_under(g)) == [("cat", "fn"), ("feat", "fn"), ("top", "fn")]


@pytest.mark.parametrize("link", [("fn", "feat"), ("feat", "fn")])
def test_semantic_trace_in_both_orientations(make, link):
    g = make(
        {"d": "Domain", "feat": "Feature", "fn": {}, "file": "File"},
        [("d", "feat", "PARENT_OF"), (*link, "IMPLEMENTS"), ("fn", "file", "DEFINED_IN")],
    )
    assert rows(paths.semantic_trace(g, "fn")) == [("d", "feat", "fn", "file")]


def test_volatility_rules_and_scores(make):
    g = make(
        {
            "a": {"is_volatile": True}, "b": {}, "c": {"content": "open socket"}, "d": {"name": "render"},
            "f": {"label": "File", "file": "ui/x.go"},
        },
        [("b", "c", "CALLS"), ("d", "b", "CALLS")] + [(n, "f", "DEFINED_IN") for n in "abcd"],
    )
    rules = [volatility.VolatilityRule("io", ".*socket", "function", "content"), volatility.VolatilityRule("ui", "rend", "function")]
    seeded = volatility.seed_volatility(g, "ui/.*", rules)
    assert ids(seeded.nodes.where("is_volatile")) == ["c"]
    assert dict(rows(volatility.volatility_scores(seeded))) == {"a": 0.0, "b": 0.5, "c": 1.0, "d": pytest.approx(1 / 3)}
    spread = volatility.propagate_volatility(seeded)
    assert ids(spread.nodes.where("is_volatile")) == ["b", "c", "d"]
    assert volatility.count_volatile(spread).first()[0] == 3
    scores = {r["id"]: r["risk_score"] for r in volatility.risk_scores(spread).collect()}
    assert max(scores.values()) == 1.0 and min(scores.values()) >= 0.0


def test_link_tests(make):
    g = make(
        {
            "p": {"name": "Cov"}, "m": {"name": "Run", "label": "Method"},
            "t1": {"name": "TestCov", "is_test": True}, "t2": {"name": "CovTest", "is_test": True}, "t3": {"name": "CovTests", "is_test": True},
            "t4": {"name": "TestOther", "is_test": True}, "t5": {"name": "RunTest", "is_test": True, "label": "Method"},
        }
    )
    assert rows(testlinks.test_links(g)) == [("t1", "p"), ("t2", "p"), ("t3", "p"), ("t5", "m")]
    twice = testlinks.link_tests(testlinks.link_tests(g))
    assert twice.edges.count() == 4


def test_incremental_closure_and_delete(make, spark):
    g = make(
        {n: {"label": "File", "file": n} for n in ("a.h", "b.h", "c.cpp", "d.cpp")} | {"fn": {"file": "c.cpp"}},
        [("c.cpp", "b.h", "INCLUDES"), ("b.h", "a.h", "INCLUDES"), ("fn", "c.cpp", "DEFINED_IN"), ("d.cpp", "fn", "USES")],
    )
    changed = spark.createDataFrame([("a.h",)], "file string")
    sources = spark.createDataFrame([("new.cpp",)], "file string")
    affected = incremental.affected_files(g, changed, sources)
    assert ids(affected, "file") == ["a.h", "b.h", "c.cpp", "new.cpp"]
    left = incremental.delete_affected(g, affected)
    assert ids(left.nodes) == ["d.cpp"] and left.edges.count() == 0


def test_topology_clear_and_update(make, spark):
    g = make({"f": {}, "old": "Feature", "d": "Domain"}, [("d", "old", "PARENT_OF"), ("f", "old", "IMPLEMENTS"), ("f", "f", "CALLS")])
    bare = topology.clear_topology(g)
    assert ids(bare.nodes) == ["f"] and rows(bare.edges) == [("f", "f", "CALLS")]
    fresh = make({"new": "Feature"})
    edges = spark.createDataFrame([("f", "new", "IMPLEMENTS"), ("gone", "new", "IMPLEMENTS")], "src string, dst string, type string")
    done = topology.update_topology(bare, fresh.nodes, edges)
    assert ids(done.nodes) == ["f", "new"] and done.edges.count() == 2


def test_state_and_dispatch(make):
    g = make({"a": {}, "b": {}}, [("a", "b", "CALLS")])
    assert structure.graph_state(g).first()[0] == ""
    done = structure.update_graph_state(structure.update_graph_state(g, "c1"), "c2")
    assert rows(run_query(done, "status")) == [(3, "c2")]
    assert rows(run_query(g, "impact", target="b")) == [("a", False)]
    assert rows(run_query(g, "what-if", summary=True, targets=["a"]))[0] == ("affected", 2)
    with pytest.raises(ValueError):
        run_query(g, "nonsense")
    assert run_sql(g, "select id, embedding from nodes").columns == ["id"]
    with pytest.raises(ValueError):
        run_sql(g, "drop view nodes")


def test_hub_with_a_third_of_all_edges(make, spark):
    """One node is called by a third of all others; nothing is dropped."""
    n = 3000
    nodes = spark.range(n).selectExpr("concat('f', id) as id", "'Function' as label", "concat('f', id) as name", "id = 0 as is_volatile")
    edges = spark.range(1, n).selectExpr("concat('f', id) as src", "concat('f', if(id % 3 = 0, 0, (id * 7) % 3000)) as dst", "'CALLS' as type")
    from graphloom.model import PropertyGraph, conform_nodes

    g = PropertyGraph(conform_nodes(nodes), edges)
    assert neighborhood.callers(g, "f0").count() == edges.where("dst = 'f0' and src <> dst").count()
    out = dict(rows(volatility.volatile_hops(g)))
    succ = {r["src"]: r["dst"] for r in edges.collect()}

    def hops(node):
        seen, count = set(), 0
        while node != "f0":
            if node in seen or node not in succ:
                return None
            seen.add(node)
            node, count = succ[node], count + 1
        return count

    want = {f"f{i}": hops(f"f{i}") for i in range(n)}
    assert out == {k: v for k, v in want.items() if v is not None}
    assert g.nodes.where(F.col("is_volatile")).count() == 1


def test_sql_reads_only_and_shows_no_vectors(spark, make):
    from graphloom.api import run_sql

    g = make({"a": {"embedding": [1.0, 0.0]}, "b": "Function"}, [("a", "b", "CALLS")])
    spark.range(3).createOrReplaceTempView("nodes")
    assert rows(run_sql(g, "select n.id, e.dst from nodes n join edges e on e.src = n.id order by 1 -- done")) == [("a", "b")]
    assert rows(run_sql(g, "with x as (select id from nodes) select count(*) from x")) == [(2,)]
    assert spark.table("nodes").count() == 3
    spark.catalog.dropTempView("nodes")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("nodes", "edges"))]
    for bad in ("FROM nodes INSERT INTO t SELECT id", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "DROP TABLE t", "SELECT 1) a INSERT INTO t (SELECT 2", "CREATE TABLE t AS SELECT 1", "SET a=b"):
        with pytest.raises(ValueError, match="read-only"):
            run_sql(g, bad)
    assert rows(run_sql(g, "select id, embedding e from nodes")) == [("a", None), ("b", None)]


def test_a_file_of_many_wide_commits_is_no_list_and_commits_are_dealt_out(spark):
    touched = spark.range(3000, numPartitions=1).selectExpr("cast(id % 1000 as string) as commit", "'2024' as changed_at", "concat('f', id div 1000) as file")
    best = history.co_change_counts(touched, wide=2)
    plan = best._jdf.queryExecution().toString()
    assert "commit" not in " ".join(line for line in plan.splitlines() if "collect_list" in line)
    assert sorted((r["file"], r["other"], r["together"]) for r in best.collect()) == [(f"f{a}", f"f{b}", 1000) for a in range(3) for b in range(3) if a != b]
    apart = history.co_change_counts(touched)
    assert sorted((r["file"], r["other"], r["together"]) for r in apart.collect()) == [(f"f{a}", f"f{b}", 1000) for a in range(3) for b in range(3) if a != b]
