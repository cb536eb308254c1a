import json
import os
import re

import pytest
from frames import ids, rows
from pyspark.sql import functions as F

from graphloom import api
from graphloom.functions.text import (
    common_ancestor, domain_names, dominant_terms, json_in_text, node_to_text, pattern_in_scope, slice_lines,
)
from graphloom.model import sanitize_label
from graphloom.operators import backlog
from graphloom.operators.upsert import merge_nodes
from graphloom.sources import build, files, gitlog, jsonl, store
from graphloom.session import cut_in_place
from graphloom.sources.languages import extract, is_test_file, mask_page
from graphloom.sources.scopes import enclosing
from graphloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "paths, want",
    [
        (["/a/b/c", "/a/b/d"], "/a/b"), (["/a/b", "/a/b/c"], "/a/b"), (["/a/b", "/c/d"], "/"), (["/a/b", "/a/bc"], "/a"),
        (["a/b", "a/c"], "a"), (["a/b", "c/d"], "."), (["/a/b", "a/b"], ""), (["a//b/./x/../c"], "a/b/c"),
    ],
)
def test_common_ancestor(spark, paths, want):
    df = spark.createDataFrame([("g", p) for p in paths], "g string, path string")
    assert rows(common_ancestor(df, ["g"])) == [("g", want)]


@pytest.mark.parametrize(
    "lca, names, want",
    [
        ("internal/auth", [], "Auth"), ("internal/services/payment", [], "Payment"), (".", ["LoginUser", "LogoutUser", "RegisterUser"], "User"),
        (".", ["processData", "LoadData", "save_data"], "Data"), ("internal", ["ApiHandler", "ApiMiddleware"], "Api"),
        ("pkg", ["Logger", "LogFormatter", "LogWriter"], "Log"), (".", ["A", "B"], ""),
    ],
)
def test_domain_names(spark, lca, names, want):
    lcas = spark.createDataFrame([("g", lca)], "g string, lca string")
    terms = dominant_terms(spark.createDataFrame([("g", n) for n in names], "g string, name string"), ["g"])
    assert domain_names(lcas, terms, ["g"]).first()["domain_name"] == want


def test_text_columns(spark):
    text = F.lit("1\n2\n3\n4\n5\n")
    cases = {(2, 4): "2\n3\n4", (3, 3): "3", (4, 10): "4\n5", (10, 15): "", (5, 2): ""}
    assert {k: one(spark, slice_lines(text, F.lit(k[0]), F.lit(k[1]))) for k in cases} == cases
    body = F.lit("a\ntarget\nb\ntarget x\nc")
    sizes = lambda ctx: [len(m) for m in one(spark, pattern_in_scope(body, F.lit("target"), ctx, F.lit(10)))]
    assert (sizes(0), sizes(1), sizes(2)) == ([1, 1], [3, 3], [4, 4])
    assert one(spark, pattern_in_scope(body, F.lit("target"), 0, F.lit(10)))[1][0]["number"] == 13
    named = node_to_text(F.lit("src/p.go"), F.lit("Pay"), F.array(F.lit("a"), F.lit("b")), F.lit("id"))
    assert one(spark, named) == "src/p.go | Pay | a, b"
    nothing = F.lit(None).cast("string")
    assert one(spark, node_to_text(nothing, F.lit(""), F.lit(None).cast("array<string>"), F.lit("id"))) == "id"
    for raw, want in {"```json\n{\"a\": 1}\n```": '{"a": 1}', "x [1, [2]] y": "[1, [2]]", "{ never": None, "none": None}.items():
        assert one(spark, json_in_text(F.lit(raw))) == want
    for raw, want in {"`Function`": "Function", "My-Label": "MyLabel", "Label;DROP TABLE": "LabelDROPTABLE", "Label_123": "Label_123"}.items():
        assert one(spark, sanitize_label(F.lit(raw))) == want
    for path, want in {"a_test.go": True, "XTest.java": True, "XTests.cs": True, "a.test.ts": True, "a.spec.ts": True, "x/tests/a.py": True, "a.go": False}.items():
        assert one(spark, is_test_file(F.lit(path))) is want


def test_numbers_of_json_text(spark):
    whole, real = one(spark, jsonl.number(F.lit("10"))), one(spark, jsonl.number(F.lit("1.5")))
    assert (whole["as_long"], real["as_long"], real["as_double"]) == (10, None, 1.5)


LINES = [
    {"id": "a", "type": "Function", "name": "old", "fqn": "m.a", "start_line": "7", "atomic_features": ["x", "y"], "k": {"n": 1}},
    {"id": "a", "type": "Function", "name": "new", "other": 2.5},
    {"id": "b1", "type": "Func-tion", "fqn": "m.b"}, {"id": "b2", "fqn": "m.b"}, {"id": ""},
    {"source": "a", "target": "m.b", "type": "CALLS"}, {"source": "a", "target": "b1", "type": "CALLS"}, {"source": "a", "target": "a", "type": ""},
    {"source": "a", "target": "gone", "type": "CALLS"}, {"source": "m.a", "target": "b1", "type": "CALLS"}, {"source": "a", "type": "CALLS"},
]


def lines_frame(spark, records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), i) for i, r in enumerate(records)], "value string, seq bigint")


def test_load_merges_nodes_and_resolves_edges(spark):
    g = jsonl.load_graph(lines_frame(spark, LINES + ["{broken", "42", "[1]"]))
    a = g.nodes.where("id = 'a'").first()
    assert (a["name"], a["fqn"], a["start_line"], a["atomic_features"]) == ("new", "m.a", 7, ["x", "y"])
    assert a["extra"] == {"k": '{"n":1}', "other": "2.5"} and a["labels"] == ["CodeElement", "Function"]
    assert rows(g.nodes, "id", "label") == [("a", "Function"), ("b1", "Function"), ("b2", "Generic")]
    assert rows(g.edges) == [("a", "a", "RELATED_TO"), ("a", "b1", "CALLS"), ("a", "b2", "CALLS")]


def test_loading_takes_as_many_tasks_as_lines_and_edges_ask_for(spark, tmp_path, monkeypatch):
    from graphloom import session
    from graphloom.operators import upsert

    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes"
    before = [spark.conf.get(n) for n in names]
    monkeypatch.setattr(session, "SPLIT", "4k")
    monkeypatch.setattr(upsert, "EDGES", 100)
    pairs = [(i % 300, i * 7 % 331) for i in range(3000)]
    records = [{"id": f"n{i}", "fqn": f"m.{i}"} for i in range(300)] + [{"source": f"n{a}", "target": f"{'m.' if b % 2 else 'n'}{b}", "type": "CALLS"} for a, b in pairs]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    g = jsonl.read_graph(spark, str(tmp_path / "g.jsonl"))
    assert rows(g.edges) == sorted({(f"n{a}", f"n{b}", "CALLS") for a, b in pairs if b < 300}, key=repr)
    assert g.nodes.count() == 300
    assert g.edges.rdd.getNumPartitions() == 30 and g.nodes.rdd.getNumPartitions() > 30
    assert [spark.conf.get(n) for n in names] == before


def test_one_id_with_a_third_of_all_versions(spark):
    from graphloom.model import conform_nodes

    raw = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', concat('n', id)) as id", "'Function' as label", "concat('v', id) as name", "id as seq")
    nodes = conform_nodes(raw).withColumn("seq", F.lit(0)).drop("seq").join(raw.selectExpr("name", "seq"), "name").select(*conform_nodes(raw).columns, "seq")
    merged = merge_nodes(nodes)
    assert merged.count() == 4001 and merged.where("id = 'hot'").first()["name"] == "v5997"


def test_write_and_read_back(spark, make, tmp_path):
    g = make({"a": {"fqn": "m.a", "atomic_features": ["p", "q"], "is_test": True}, "b": "File"}, [("a", "b", "DEFINED_IN")])
    jsonl.write_combined(g, str(tmp_path / "all"))
    back = jsonl.read_graph(spark, str(tmp_path / "all"))
    assert rows(back.nodes, "id", "label", "fqn", "atomic_features", "is_test") == rows(g.nodes, "id", "label", "fqn", "atomic_features", "is_test")
    assert rows(back.edges) == rows(g.edges)
    jsonl.write_split(g, str(tmp_path / "n"), str(tmp_path / "e"))
    assert jsonl.read_graph(spark, [str(tmp_path / "n"), str(tmp_path / "e")]).edges.count() == 1
    store.write_graph(g, str(tmp_path / "store"))
    stored = store.read_graph(spark, str(tmp_path / "store"))
    assert rows(stored.labelled("File"), "id") == [("b",)] and rows(stored.of_type("DEFINED_IN")) == rows(g.edges)
    plan = stored.of_type("DEFINED_IN")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan


def test_incremental_ingest(spark, tmp_path):
    folder, done, kept = tmp_path / "in", str(tmp_path / "progress"), str(tmp_path / "store")
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join(json.dumps(r) for r in LINES))
    ingest.ingest(spark, str(folder), kept, done, buckets=4)
    (folder / "2.jsonl").write_text(json.dumps({"id": "a", "name": "newest"}) + "\n" + json.dumps({"source": "b1", "target": "a", "type": "CALLS"}))
    ingest.ingest(spark, str(folder), kept, done, buckets=4)
    ingest.ingest(spark, str(folder), kept, done, buckets=4)
    g = ingest.current_graph(spark, kept)
    assert g.nodes.where("id = 'a'").first()["name"] == "newest"
    assert g.nodes.where("id = 'a'").first()["fqn"] == "m.a"
    assert ("b1", "a", "CALLS") in rows(g.edges)


def test_source_tree_with_ignore_files(spark, tmp_path):
    tree = {
        ".gitignore": "*.log\n/build/\n!keep.log\n", "a.py": "x", "__init__.py": "y", "x.log": "", "keep.log": "", "build/out.py": "",
        "sub/.gitignore": "secret.py\n", "sub/secret.py": "", "sub/deep/secret.py": "", "sub/ok.py": "z", "secret.py": "", ".git/config": "",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.list_files(spark, str(tmp_path))
    assert ids(found, "path") == sorted([".gitignore", "__init__.py", "a.py", "keep.log", "secret.py", "sub/.gitignore", "sub/deep/secret.py", "sub/ok.py"])
    read = dict(rows(files.read_files(found.unionByName(spark.createDataFrame([("gone.py",)], "path string")), str(tmp_path))))
    assert read["sub/ok.py"] == "z" and read["__init__.py"] == "y" and "gone.py" not in read


def test_log_file(spark, tmp_path):
    (tmp_path / "log.txt").write_text("COMMIT|2024-01-02\n\na.go\nb.go\nCOMMIT|2024-01-01\n\na.go\n")
    got = gitlog.read_log(spark, str(tmp_path))
    assert rows(got, "changed_at", "file") == [("2024-01-01", "a.go"), ("2024-01-02", "a.go"), ("2024-01-02", "b.go")]


def test_page_mask_keeps_lines(spark):
    page = "<%@ Page %>\r\n<b>Call()</b>\n<% x = 1\n y %> <%= z %>\n<script runat=\"server\">\nSub A()\n</script>"
    masked = one(spark, mask_page(F.lit(page)))
    assert masked.count("\n") == page.count("\n") and "Call" not in masked and "script" not in masked
    assert masked.split("\n")[2].strip() == "x = 1" and "z" in masked.split("\n")[3] and "Sub A()" in masked.split("\n")[5]


def test_extract_then_load_links_across_files(spark):
    sources = spark.createDataFrame(
        [
            ("a.ts", "import { B } from './b';\nexport function run() {\n  const b = new B();\n  helper();\n}\nfunction helper() { }\n"),
            ("b.ts", "export class B {\n  go() {\n    if (x) {\n      this.stop();\n    } else {\n      done();\n    }\n  }\n  stop() { }\n}\n"),
            ("c.test.ts", "describe('adds', () => {\n});\n"), ("skip.txt", "class X"),
        ],
        "path string, text string",
    )
    raw = extract(sources)
    from graphloom.operators.upsert import resolve_edges

    nodes = merge_nodes(raw.nodes.withColumn("seq", F.lit(0)))
    calls = rows(resolve_edges(nodes, raw.edges).where("type = 'CALLS'"), "src", "dst")
    assert ("Function:a.ts:run:", "Class:b.ts:B:") in calls and ("Function:a.ts:run:", "Function:a.ts:helper:") in calls
    assert ("Function:b.ts:B.go:", "Function:b.ts:B.stop:") in calls
    assert rows(nodes.where("is_test"), "id") == [("Function:c.test.ts:adds:",), ("c.test.ts",)]
    spans = {r["name"]: (r["start_line"], r["end_line"]) for r in nodes.where("label = 'Function'").collect()}
    assert spans["go"] == (2, 8) and spans["stop"] == (9, 9) and spans["run"] == (2, 5)


def test_fetch_and_locate(spark, make):
    g = make(
        {"f": {"file": "x.go", "start_line": 2, "end_line": 3}, "whole": {"file": "x.go"}, "t": {"name": "target"}, "n": {}},
    )
    sources = spark.createDataFrame([("x.go", "1 target\n2 target\n3 other\n4")], "file string, text string")
    assert api.fetch_source(g, "f", sources).first()["content"] == "2 target\n3 other"
    assert api.fetch_source(g, "whole", sources).first()["content"].startswith("1 target")
    assert rows(api.locate_usage(g, "f", "t", sources)) == [(2, "2 target")]
    assert api.locate_usage(g, "whole", "t", sources).count() == 0
    with pytest.raises(LookupError):
        api.locate_usage(g, "f", "nobody", sources)


def test_work_lists_treat_missing_descriptors_as_unusable(make):
    g = make(
        {
            "none": {"embedding": [1.0]}, "unknown": {"embedding": [1.0], "atomic_features": ["unknown"]},
            "good": {"embedding": [1.0], "atomic_features": ["unknown", "more"]}, "empty": {"embedding": [1.0], "atomic_features": []},
            "test": {"embedding": [1.0], "atomic_features": ["x"], "is_test": True}, "feat": {"label": "Feature", "embedding": [1.0]},
        }
    )
    assert ids(backlog.embeddings_only(g)) == ["empty", "feat", "good"]
    assert ids(backlog.unnamed(g)) == ["feat"]


def test_build_all(spark, make):
    g = make(
        {f"f{i}": {"file": f"src/app/m{i % 3}.go", "start_line": 1, "end_line": 2, "name": f"LoadUser{i}"} for i in range(12)}
        | {f"m{i}": {"label": "File", "file": f"src/app/m{i}.go"} for i in range(3)} | {"t": {"name": "TestLoadUser1", "is_test": True}},
        [(f"f{i}", f"m{i % 3}", "DEFINED_IN") for i in range(12)] + [("f1", "f0", "CALLS")],
    )
    sources = spark.createDataFrame([(f"src/app/m{i}.go", "line one\nline two") for i in range(3)], "file string, text string")
    touches = spark.createDataFrame([(c, "2024", f"src/app/m{c % 2}.go") for c in range(4)], "commit bigint, changed_at string, file string")
    extractor = lambda code, name: F.struct(F.array(F.lower(name)).alias("features"), name.endswith("0").alias("is_volatile"))
    embedder = lambda text: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(100)) + 1).cast("float"))
    summarizer = lambda snippets, label: F.struct(F.concat(label, F.lit(" named")).alias("name"), F.array_join(snippets, "|").alias("description"))
    done = api.build_all(g, sources, touches, extractor, embedder, summarizer, "c0ffee")
    nodes = {r["id"]: r for r in done.nodes.collect()}
    assert nodes["f1"]["is_volatile"] and nodes["f0"]["risk_score"] > 0 and nodes["m0"]["change_frequency"] == 2
    assert rows(done.edges.where("type = 'TESTS'")) == [("t", "f1", "TESTS")]
    assert all(r["name"].endswith("named") for r in nodes.values() if r["label"] in ("Feature", "Domain"))
    assert api.run_query(done, "status").first()["commit"] == "c0ffee"


def test_flags(spark):
    raw = F.lit("/W4 /MP /YuStdAfx.h  %(AdditionalOptions) /fp:fast /utf-8")
    assert one(spark, build.translate_flags(build.split_options(raw))) == ["/W4", "/utf-8"]


def _graph(spark, path, text):
    g = extract(spark.createDataFrame([(path, text)], "path string, text string"))
    return rows(g.nodes, "id", "start_line", "end_line"), rows(g.edges)


def test_a_header_of_forty_lines(spark):
    params = ",\n".join(f"        int p{i}" for i in range(40))
    nodes, edges = _graph(spark, "A.java", f"package x;\npublic class A {{\n    public void run(\n{params}\n    ) {{\n        stop();\n    }}\n    void stop() {{\n    }}\n}}\n")
    run = "Function:x.A.run:(" + ",".join(["int"] * 40) + ")"
    assert (run, 3, 46) in nodes and (run, "x.A.stop", "CALLS") in edges


def test_comments_and_strings_over_lines_are_no_code(spark):
    java = "package x;\nclass A {\n  /* if (x) {\n     { gone(1);\n  */\n  String s = \"{ // \\\" {\"; // }\n  void run() {\n    stop('{');\n  }\n}\nclass B {\n}\n"
    nodes, edges = _graph(spark, "A.java", java)
    assert ("Class:x.A:", 2, 10) in nodes and ("Class:x.B:", 11, 12) in nodes
    assert not [e for e in edges if "gone" in e[1]] and ("Function:x.A.run:()", "x.A.stop", "CALLS") in edges
    ts = "export class A {\n  text = `{\n ${1} {\n`;\n  run(): void {\n    // }\n    go();\n  }\n}\n"
    nodes, _ = _graph(spark, "a.ts", ts)
    assert ("Class:a.ts:A:", 1, 9) in nodes and ("Function:a.ts:A.run:", 5, 8) in nodes
    py = 'def a():\n    """Says foo(1)\n  or "bar(2)" and more\n    """\n    b(1)  # c(3)\n\ndef b(x):\n    return """d(4)\nclass Not:\n"""\n'
    nodes, edges = _graph(spark, "a.py", py)
    assert ("Function:a.py:a:", 1, 5) in nodes and ("Function:a.py:b:", 7, 10) in nodes and not [n for n in nodes if "Not" in n[0]]
    assert [(s, d) for s, d, t in edges if t == "CALLS"] == [("Function:a.py:a:", "Function:a.py:b:")]


def test_imports_as_they_are_written(spark):
    py = "import a.b as x, os\nfrom m.n import (\n    foo,  # first\n    bar as baz,\n)\nfrom k import \\\n    one\n\ndef f():\n    foo(1)\n    baz(2)\n    one()\n    x.go()\n    os.getcwd()\n"
    _, edges = _graph(spark, "p.py", py)
    assert sorted(d for _, d, t in edges if t == "CALLS") == [f"Function:p.py:{n}:" for n in ("a.b.go", "k.one", "m.n.bar", "m.n.foo", "os.getcwd")]
    ts = "import {\n  add,\n  sub as minus,\n} from './math';\nimport start, { type Kind } from \"../base\";\nimport * as all from 'lib';\n// import { no } from './no';\nexport function f() {\n  add(1);\n  minus(2);\n  start();\n  no();\n}\n"
    _, edges = _graph(spark, "C:\\src\\app\\f.ts", ts)
    assert sorted(d for s, d, t in edges if t == "CALLS") == ["C:/src/app/f.ts:no", "C:/src/app/math.ts:add", "C:/src/app/math.ts:sub", "C:/src/base.ts:start"]


def test_lines_keep_the_order_of_paths_files_and_lines(spark, tmp_path):
    from graphloom.sources.jsonl import read_graph, read_lines

    big, small = tmp_path / "b.jsonl", tmp_path / "a.jsonl"
    pad = "x" * 200
    big.write_text("".join(f'{{"id":"n{i}","type":"Function","name":"big{i}","pad":"{pad}"}}\n' for i in range(3000)))
    small.write_text("".join(f'{{"id":"n{i}","type":"Function","name":"small{i}"}}\n' for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for paths, last in (([str(small), str(big)], "big"), ([str(big), str(small)], "small"), (str(tmp_path), "big")):
            names = {r["id"]: r["name"] for r in read_graph(spark, paths).nodes.collect()}
            assert names == {f"n{i}": f"{last}{i}" for i in range(3000)}
        lines = [r[0] for r in read_lines(spark, [str(small)]).orderBy("seq").collect()]
        assert lines == small.read_text().splitlines()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_later_batches_win_whatever_their_partitions(spark, tmp_path):
    from graphloom.streaming.ingest import current_graph, ingest

    folder, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    os.mkdir(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for batch in range(2):
            lines = [f'{{"id":"n{i % 150}","type":"Function","name":"b{batch} v{i // 150}","pad":"{"y" * 500}"}}' for i in range(1500)]
            with open(f"{folder}/f{batch}.jsonl", "w") as out:
                out.write("\n".join(lines))
            ingest(spark, folder, store, progress, buckets=2)
            assert {r["name"] for r in current_graph(spark, store).nodes.collect()} == {f"b{batch} v9"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_compile_commands_are_one_array(spark, tmp_path):
    from graphloom.sources.build import join_files, write_compile_commands

    rows_ = [("/r", f"/r/{i:04d}.cpp", ["clang-cl", "/c", f"/r/{i}.cpp"]) for i in range(300)] + [("/r", "/r/0007.cpp", ["clang-cl", "/c", "/r/7.cpp"])]
    frame = spark.createDataFrame(rows_, "directory string, file string, arguments array<string>").repartition(4)
    for count in (301, 2, 1, 0):
        path, one = str(tmp_path / f"c{count}"), str(tmp_path / f"c{count}.json")
        write_compile_commands(frame.orderBy("file").limit(count), path)
        join_files(spark, path, one)
        with open(one) as f:
            found = json.load(f)
        assert [x["file"] for x in found] == sorted(r[1] for r in rows_)[:count] and all(list(x) == ["directory", "file", "arguments"] for x in found)


def test_a_million_compile_commands(spark, tmp_path):
    from graphloom.sources.build import join_files, write_compile_commands

    frame = spark.range(1_000_000).select(F.lit("/r").alias("directory"), F.format_string("/r/%07d.cpp", "id").alias("file"), F.array(F.lit("clang-cl")).alias("arguments"))
    write_compile_commands(frame, str(tmp_path / "many"))
    assert len([p for p in os.listdir(tmp_path / "many") if p.startswith("part-")]) > 1
    join_files(spark, str(tmp_path / "many"), str(tmp_path / "many.json"))
    with open(tmp_path / "many.json") as f:
        found = json.load(f)
    assert len(found) == 1_000_000 and found[0]["file"] == "/r/0000000.cpp" and found[-1]["file"] == "/r/0999999.cpp"


def test_a_wide_and_deep_tree_is_listed_by_tasks(spark, tmp_path):
    want, rules = [], {"": "*.log\n/skip/\n!keep*.log\n", "d3": "*.txt\n!a*.txt\nx/\n", "d3/x": "!*\n", "d4/x/y": "!*.log\n"}
    for top in range(20):
        for sub in ("", "x", "y", "x/y", "x/y/z", "skip"):
            folder = tmp_path / f"d{top}" / sub
            folder.mkdir(parents=True, exist_ok=True)
            for i in range(420):
                name = f"{'abk'[i % 3]}{i}" + (".log", ".txt", ".py", ".log")[i % 4]
                (folder / name).touch()
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "a.py").touch()
    (tmp_path / "d0" / "keep.log").touch()
    os.symlink(tmp_path, tmp_path / "d1" / "loop")
    for folder, text in rules.items():
        (tmp_path / folder / ".gitignore").write_text(text)
    for base, folders, names in os.walk(tmp_path):
        inside = os.path.relpath(base, tmp_path).replace(".", "", 1) if base != str(tmp_path) else ""
        folders[:] = [f for f in folders if not os.path.islink(f"{base}/{f}")]
        for name in names:
            path = f"{inside}/{name}" if inside else name
            # A rule with a slash holds for its folder alone, one without at any depth.
            if "skip" in inside.split("/") or path.startswith("d3/x/"):
                continue
            gone = name.endswith(".log") and not name.startswith("keep") and inside != "d4/x/y"
            gone = gone or (inside == "d3" and name.endswith(".txt") and not name.startswith("a"))
            if not gone:
                want.append(path)
    found = files.list_files(spark, str(tmp_path))
    got = ids(found, "path")
    assert len(got) > 20_000 and [p for p in got if p != "d1/loop"] == sorted(want)


def test_ignore_classes():
    from graphloom.sources.files import _pattern

    match = lambda rule, path: re.search(_pattern(rule).replace("\\z", "\\Z"), path) is not None
    assert match("*.py[cod]", "b/a.pyc") and not match("*.py[cod]", "a.py") and match("x[!a-c]y", "xdy") and not match("x[!a-c]y", "xby")
    assert match("a\\*b", "a*b") and not match("a\\*b", "axb") and not match("a[!b]c", "a/c") and match("[[]x", "[x")


def test_a_null_takes_a_value_away(spark):
    lines = [
        '{"id":"a","type":"Function","name":"x","file":"f","start_line":3,"note":"n","kept":"k"}', '{"id":"a","type":"Function","file":null,"note":null,"start_line":null}',
        '{"id":"b","type":"Function","name":"y","note":null}', '{"id":"b","type":"Function","note":"back","name":null}', '{"id":"b","type":"Function","name":"again"}',
    ]
    g = jsonl.load_graph(spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, seq bigint"))
    got = {r["id"]: (r["name"], r["file"], r["start_line"], r["extra"]) for r in g.nodes.collect()}
    assert got == {"a": ("x", None, None, {"kept": "k"}), "b": ("again", None, None, {"note": "back"})}
    from graphloom.operators.upsert import upsert_nodes

    records = jsonl.parse_lines(spark.createDataFrame([('{"id":"a","kept":null,"name":"z"}', 0)], "value string, seq bigint"))
    after = {r["id"]: (r["name"], r["extra"]) for r in upsert_nodes(g, jsonl.node_records(records)).nodes.collect()}
    assert after == {"a": ("z", None), "b": ("again", {"note": "back"})}


def test_extraction_gathers_no_lines_and_uses_all_tasks(spark):
    files = spark.range(50, numPartitions=1).selectExpr("concat('p', id, '.py') as path", "concat('import os\\nclass A', id, ':\\n    def f(self):\\n        os.x()\\n') as text")
    graph = extract(files, ("python",))
    assert "Broadcast" not in graph.edges._jdf.queryExecution().executedPlan().toString()
    assert graph.nodes.where("label = 'File'").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert graph.edges.where("type = 'CALLS'").count() == 50


def test_project_files_of_one_partition_are_dealt_out(spark):
    text = '<Project><ItemGroup><ClCompile Include="a.cpp"/></ItemGroup></Project>'
    projects = spark.range(40, numPartitions=1).selectExpr("concat('/r/p', id, '/p.vcxproj') as path").selectExpr("path", f"'{text}' as text")
    sheets = spark.createDataFrame([], "path string, text string")
    for parsed in (build.projects(projects, "Release|x64"), build.projects(projects, "Release|x64", sheets)):
        assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert build.compile_commands(parsed).count() == 40


def test_rows_of_a_file_stay_where_it_is(spark):
    rows = [(f"f{i % 5}", i // 5, i % 3) for i in range(60)]
    lines = cut_in_place(spark.createDataFrame(rows, "path string, n bigint, level int").repartition(3, "path"))
    defs = lines.where("n % 4 = 0").withColumn("end_line", F.col("n") + 3).withColumn("kind", F.lit("class")).withColumn("name", F.concat("path", F.lit("."), "n")).withColumn("signature", F.lit(""))
    items = lines.withColumn("item", F.concat_ws("#", "path", "n"))
    found = enclosing(items, defs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Broadcast" not in plan
    got = {(r["path"], r["n"]): [d["n"] for d in r["around"] or []] for r in found.collect()}
    assert len(got) == 60
    for path, n, level in rows:
        # The last definition of each lower level, where it has not ended.
        want = []
        for at in range(level):
            held = [m for p, m, own in rows if p == path and own == at and m % 4 == 0 and m <= n]
            want += [max(held)] if held and max(held) + 3 >= n else []
        assert got[path, n] == want
