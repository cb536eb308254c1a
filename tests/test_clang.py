import json
import subprocess
import sys
from pathlib import Path

from frames import rows
from pyspark.sql import functions as F

from graphloom import steps
from graphloom.sources import clang_ast
from graphloom.sources.clang_ast import extract_trees


def decl(kind, name=None, decl_id=None, inner=(), **more):
    node = {"kind": kind, "id": decl_id or f"0x{name}", **more}
    if name:
        node["name"] = name
    if inner:
        node["inner"] = list(inner)
    return node


def test_tree_becomes_nodes_and_edges(spark):
    call = decl("CallExpr", decl_id="0x9", inner=[decl("DeclRefExpr", decl_id="0x8", referencedDecl={"id": "0xhelper", "kind": "FunctionDecl"})])
    member = decl("CXXMemberCallExpr", decl_id="0x7", inner=[decl("MemberExpr", decl_id="0x6", referencedMemberDecl="0xstop")])
    usage = decl("DeclRefExpr", decl_id="0x5", referencedDecl={"id": "0xcount", "kind": "VarDecl"})
    passed = decl("CallExpr", decl_id="0x3", inner=[decl("DeclRefExpr", decl_id="0x2", referencedDecl={"id": "0xstop"}), decl("DeclRefExpr", decl_id="0x2a", referencedDecl={"id": "0xrun"})])
    body = decl("CompoundStmt", decl_id="0x4", inner=[call, member, usage, decl("VarDecl", "local"), passed])
    tree = decl(
        "TranslationUnitDecl", decl_id="0x1",
        inner=[
            decl("VarDecl", "count", loc={"line": 2}),
            decl("FunctionDecl", "helper", inner=[decl("ParmVarDecl", "x", type={"qualType": "int"})], type={"qualType": "int (int)"}, loc={"line": 3}, range={"begin": {}, "end": {"line": 5}}),
            decl(
                "NamespaceDecl", "app",
                inner=[
                    decl("CXXRecordDecl", "Base", completeDefinition=True),
                    decl(
                        "CXXRecordDecl", "Shop", completeDefinition=True,
                        bases=[{"type": {"qualType": "app::Base"}}, {"type": {"qualType": "std::string"}}],
                        inner=[
                            decl("FieldDecl", "size", type={"qualType": "int"}), decl("FieldDecl", "base", type={"qualType": "const app::Base *"}),
                            decl("CXXMethodDecl", "stop", type={"qualType": "void ()"}),
                            decl("CXXMethodDecl", "run", type={"qualType": "void (int, char)"}, inner=[*(decl("ParmVarDecl", p, type={"qualType": p}) for p in ("int", "char")), body]),
                            decl("CXXConstructorDecl", "Shop", decl_id="0xi", isImplicit=True, type={"qualType": "void ()"}),
                        ],
                    ),
                ],
            ),
        ],
    )
    files = spark.createDataFrame([("/repo/src/a.cpp", json.dumps(tree)), ("/repo/src/broken.cpp", "{")], "path string, text string")
    g = extract_trees(files, "/repo")
    assert [r[0] for r in rows(g.nodes, "id")] == [
        "Class:app::Base", "Class:app::Shop", "Field:app::Shop::base", "Field:app::Shop::size", "File:src/a.cpp", "File:src/broken.cpp", "Function:app::Shop::run:(int,char)",
        "Function:app::Shop::stop:()", "Function:helper:(int)", "Global:count",
    ]
    run = "Function:app::Shop::run:(int,char)"
    edges = rows(g.edges)
    assert {(run, "Function:helper:(int)", "CALLS"), (run, "Function:app::Shop::stop:()", "CALLS"), (run, "Global:count", "USES_GLOBAL")} <= set(edges)
    assert ("Class:app::Shop", "Class:app::Base", "INHERITS") in edges and ("Class:app::Shop", "Field:app::Shop::size", "DEFINES") in edges
    assert ("Class:app::Shop", run, "HAS_METHOD") in edges and (run, "File:src/a.cpp", "DEFINED_IN") in edges
    assert ("Class:app::Shop", "Class:app::Base", "DEPENDS_ON") in edges and (run, run, "CALLS") not in edges
    assert not [e for e in edges if "std::" in e[1]]
    spans = {r["name"]: (r["start_line"], r["end_line"]) for r in g.nodes.collect()}
    assert spans["helper"] == (3, 5)


def unit(*inner):
    return decl("TranslationUnitDecl", decl_id="0x1", inner=inner)


def params(*types):
    return [decl("ParmVarDecl", f"p{i}", decl_id=f"0xp{i}", type={"qualType": t}) for i, t in enumerate(types)]


def graph_of(spark, trees, root="/repo"):
    rows_ = [(p, t if isinstance(t, str) else json.dumps(t)) for p, t in trees.items()]
    g = extract_trees(spark.createDataFrame(rows_, "path string, text string"), root)
    return [r[0] for r in rows(g.nodes, "id")], rows(g.edges), g


def test_declarations_belong_to_their_own_file(spark):
    tree = unit(
        decl("FunctionDecl", "printf", loc={"file": "/usr/include/stdio.h", "line": 1}), decl("FunctionDecl", "_hidden", loc={"line": 2}),
        decl("FunctionDecl", "shared", loc={"file": "/Repo/src/h.h", "line": 3}, inner=params("void (*)(int)", "char")),
        decl("NamespaceDecl", "app", inner=[decl("NamespaceDecl", "std", inner=[decl("FunctionDecl", "own", loc={"line": 4})])]),
        decl("FunctionDecl", "made", isImplicit=True, inner=[decl("VarDecl", "inside")]),
        decl("FunctionDecl", "outer", inner=[decl("CompoundStmt", inner=[decl("CXXRecordDecl", "Local", completeDefinition=True)])]),
    )
    ids, edges, _ = graph_of(spark, {"/repo/src/a.cpp": tree})
    assert ids == ["File:src/a.cpp", "File:src/h.h", "Function:outer:()", "Function:shared:(void (*)(int),char)"]
    assert ("Function:shared:(void (*)(int),char)", "File:src/h.h", "DEFINED_IN") in edges


def homes_of(edges):
    return {e[0]: e[1] for e in edges if e[2] == "DEFINED_IN"}


def test_a_file_holds_until_another_is_named(spark):
    tree = unit(
        decl("VarDecl", "first", loc={"line": 1}),
        decl("FunctionDecl", "printf", loc={"file": "/usr/include/stdio.h", "line": 1}), decl("FunctionDecl", "scanf", loc={"line": 5}),
        decl("NamespaceDecl", "sys", loc={"line": 6}, inner=[decl("FunctionDecl", "deep", loc={"file": "/repo/inc/deep.h", "line": 1})]),
        decl("FunctionDecl", "helper", loc={"file": "/repo/inc/h.h", "line": 3, "includedFrom": {"file": "/repo/a.cpp"}}), decl("FunctionDecl", "helper2", loc={"line": 8}),
        decl(
            "CXXRecordDecl", "Box", completeDefinition=True, loc={"line": 10},
            inner=[decl("CXXMethodDecl", "open", loc={"line": 11}), decl("CXXMethodDecl", "shut", loc={"file": "/repo/inc/part.h", "line": 1})],
        ),
        decl("FunctionDecl", "after", loc={"line": 2}),
        decl("FunctionDecl", "made", loc={"spellingLoc": {"file": "/usr/include/macro.h", "line": 7}, "expansionLoc": {"file": "/repo/a.cpp", "line": 40, "col": 1}}),
        decl("FunctionDecl", "same_line", loc={"col": 9}, range={"begin": {"col": 1}, "end": {"line": 44, "col": 1}}),
    )
    ids, edges, g = graph_of(spark, {"/repo/a.cpp": tree, "/repo/b.cpp": unit(decl("FunctionDecl", "own", loc={"line": 3}))})
    assert homes_of(edges) == {
        "Global:first": "File:a.cpp", "Function:helper:()": "File:inc/h.h", "Function:helper2:()": "File:inc/h.h", "Class:Box": "File:inc/h.h", "Function:Box::open:()": "File:inc/h.h",
        "Function:Box::shut:()": "File:inc/part.h", "Function:after:()": "File:inc/part.h", "Function:made:()": "File:a.cpp", "Function:same_line:()": "File:a.cpp", "Function:own:()": "File:b.cpp",
    }
    assert not [i for i in ids if "scanf" in i or "deep" in i]
    spans = {r["name"]: (r["start_line"], r["end_line"]) for r in g.nodes.collect()}
    assert spans["helper2"] == (8, 8) and spans["made"] == (40, 40) and spans["same_line"] == (40, 44)


def test_templates_hidden_classes_and_friends(spark):
    tree = unit(
        decl("CXXRecordDecl", "_Impl", completeDefinition=True, inner=[decl("CXXMethodDecl", "go")]),
        decl("CXXRecordDecl", "Declared", inner=[decl("CXXMethodDecl", "late")]),
        decl(
            "CXXRecordDecl", "Shop", completeDefinition=True, bases=[{"type": {"qualType": t}} for t in ("Base<int>", "class Plain", "std::mutex")],
            inner=[
                decl("FieldDecl", "many", type={"qualType": "List<Item>"}), decl("FieldDecl", "one", type={"qualType": "const volatile struct Item *"}), decl("FieldDecl", "n", type={"qualType": "unsigned int"}),
                decl("FriendDecl", decl_id="0xfr", inner=[decl("FunctionDecl", "helps")]), decl("VarDecl", "shared", storageClass="static"), decl("VarDecl", "odd", storageClass="register"),
            ],
        ),
    )
    ids, edges, _ = graph_of(spark, {"/repo/a.cpp": tree})
    assert {"Function:_Impl::go:()", "Function:Declared::late:()", "Function:Shop::helps:()", "Global:Shop::shared"} <= set(ids) and "Class:_Impl" not in ids
    assert [e for e in edges if e[2] == "HAS_METHOD"] == [] and not [i for i in ids if "odd" in i]
    assert [e for e in edges if e[2] in ("INHERITS", "DEPENDS_ON")] == [("Class:Shop", "Class:Item", "DEPENDS_ON"), ("Class:Shop", "Class:Plain", "INHERITS")]


def test_what_a_function_holds_is_local(spark):
    call = lambda target: decl("CallExpr", decl_id="0xc" + target, inner=[decl("ImplicitCastExpr", inner=[decl("DeclRefExpr", referencedDecl={"id": target, "kind": "FunctionDecl"})])])
    local = decl("CXXRecordDecl", "Local", completeDefinition=True, inner=[decl("CXXMethodDecl", "run", inner=[call("0xhelper")])])
    tree = unit(
        decl("FunctionDecl", "helper"), decl("FunctionDecl", "other"),
        decl("FunctionDecl", "outer", inner=[decl("CompoundStmt", inner=[decl("DeclStmt", inner=[local]), decl("VarDecl", "x"), call("0xother")]), *params("int")]),
    )
    ids, edges, _ = graph_of(spark, {"/repo/a.cpp": tree})
    # The parameters stand behind the body here; the signature has them all the same.
    assert ids == ["File:a.cpp", "Function:helper:()", "Function:other:()", "Function:outer:(int)"]
    assert [e for e in edges if e[2] == "CALLS"] == [("Function:outer:(int)", "Function:other:()", "CALLS")]


def test_broken_dumps_keep_what_stands_before(spark):
    whole = json.dumps(unit(decl("VarDecl", "a"), decl("VarDecl", "b", note='a "quoted" } ] { [ inner \\')))
    dumps = {"/repo/whole.cpp": whole, "/repo/cut.cpp": whole[: whole.index('"0xb"')], "/repo/no.cpp": "not json", "/repo/empty.cpp": "", "/repo/more.cpp": whole + "x", "/repo/blank.cpp": f"\n {whole} \n"}
    ids, _, _ = graph_of(spark, dumps)
    assert {"Global:a", "Global:b", "File:cut.cpp", "File:no.cpp", "File:empty.cpp"} <= set(ids)
    frame = spark.createDataFrame([*dumps.items(), ("/repo/null.cpp", None), ("/repo/none.cpp", "{}")], "path string, text string")
    assert [r[0] for r in rows(clang_ast.unread_trees(frame))] == ["/repo/cut.cpp", "/repo/empty.cpp", "/repo/more.cpp", "/repo/no.cpp", "/repo/null.cpp"]


def test_a_tree_deeper_than_python_s_stack(spark):
    body = '{"kind":"CallExpr","inner":[{"kind":"DeclRefExpr","referencedDecl":{"id":"0xa"}}]}'
    for _ in range(20_000):
        body = f'{{"kind":"CompoundStmt","inner":[{body}]}}' if len(body) < 300_000 else body
    deep = '{"kind":"CompoundStmt","inner":[' * 20_000 + body + "]}" * 20_000
    text = f'{{"kind":"TranslationUnitDecl","inner":[{{"kind":"FunctionDecl","id":"0xa","name":"a"}},{{"kind":"FunctionDecl","id":"0xb","name":"b","inner":[{deep}]}}]}}'
    _, edges, _ = graph_of(spark, {"/repo/a.cpp": text})
    assert ("Function:b:()", "Function:a:()", "CALLS") in edges


MEMORY = """
import json, resource, sys
from graphloom.sources.clang_ast import _Walk
node = json.dumps({"kind": "VarDecl", "id": "0x%d", "name": "v%d", "loc": {"line": 1}, "note": "x" * 700})
text = '{"kind":"TranslationUnitDecl","inner":[{"kind":"NamespaceDecl","name":"n","inner":[' + ",".join(node.replace("%d", str(i)) for i in range(180_000)) + "]}]}"
assert len(text) > 140_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(1 for _ in _Walk("/repo/a.cpp", "/repo").facts(text)) == 180_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_a_large_dump_takes_no_memory_beyond_its_text():
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parent.parent)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 50_000


def test_a_dump_beyond_the_limit_of_a_json_value(spark):
    long = json.dumps(unit(*(decl("VarDecl", f"v{i}", f"0x{i}", note="x" * 1_000_000) for i in range(140))))
    assert len(long) > 134_217_728
    ids, _, _ = graph_of(spark, {"/repo/a.cpp": long})
    assert len(ids) == 141


def test_small_dumps_are_dealt_out_and_read_as_long_ones(spark):
    tree = decl("TranslationUnitDecl", decl_id="0x1", inner=[1, decl("FunctionDecl", "f", inner=[decl("ParmVarDecl", "x", type={"qualType": "int"}), None]), decl("VarDecl", "g", loc={"line": 3})])
    text = json.dumps(tree)
    for dump in (text, text[:-5], "{}", "[]", '{"inner": 3}'):
        both = []
        for way in (clang_ast._Walk.facts, clang_ast._Walk.pulled):
            found, walk = [], clang_ast._Walk("/r/a.cpp", "/r")
            try:
                found += way(walk, dump)
            except ValueError as problem:
                found.append(str(problem))
            both.append(found)
        assert both[0] == both[1]
    files = spark.range(40, numPartitions=1).selectExpr("concat('/r/a', id, '.cpp') as path").withColumn("text", F.lit(text))
    graph = extract_trees(files, "/r")
    homes = graph.edges.where("type = 'DEFINED_IN'")
    assert homes.count() == 80
    assert "Broadcast" not in graph.edges._jdf.queryExecution().executedPlan().toString()


def test_many_small_dumps_are_few_tasks_and_long_ones_more(spark, monkeypatch):
    small = spark.range(20_000).selectExpr("concat('/r/a', id, '.cpp') as path", "'{}' as text")
    assert clang_ast._dealt(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(clang_ast, "CHARACTERS", 1_000)
    assert clang_ast._dealt(small).rdd.getNumPartitions() == 40
    assert clang_ast._dealt(small.limit(0)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_edges_of_a_loaded_graph_are_written_out(spark):
    tree = decl("TranslationUnitDecl", decl_id="0x1", inner=[decl("FunctionDecl", "f")])
    graph = steps.clang_ingest(spark.createDataFrame([("/r/a.cpp", json.dumps(tree))], "path string, text string"), "/r")
    assert graph.edges.count() == 1
    assert "Join" not in graph.edges._jdf.queryExecution().executedPlan().toString()
