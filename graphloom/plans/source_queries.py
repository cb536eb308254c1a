"""Queries over source text: one generated file per part, extracted per language.

``{k}`` in a template is the part key. The SQL states the nodes and edges a template
must give for every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.catalog import query
from graphloom.plans.retail import Tables
from graphloom.sources.clang_ast import extract_trees
from graphloom.sources.languages import extract

Row = tuple[str, str, str, str]


def _register(name: str, path: str, template: str, expected: list[Row]) -> None:
    values = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in expected)
    sql = f"""SELECT kind, replace(a, '{{k}}', p_partkey::VARCHAR) AS a, b, replace(c, '{{k}}', p_partkey::VARCHAR) AS c
    FROM part, (VALUES {values}) v(kind, a, b, c)"""

    def run(t: Tables) -> DataFrame:
        key = F.col("p_partkey").cast("string")
        files = t.part.select(
            F.replace(F.lit(path), F.lit("{k}"), key).alias("path"), F.replace(F.lit(template), F.lit("{k}"), key).alias("text")
        )
        if name == "parse_cpp":
            graph = extract_trees(files, "/repo")
        else:
            graph = extract(files, (name.split("_")[1],) if name != "parse_asp" else ("vb",))
        nodes = graph.nodes.select(
            F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"),
            F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("c"),
        )
        edges = graph.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("type").alias("b"), F.col("dst").alias("c"))
        return nodes.unionByName(edges)

    run.__doc__ = f"Nodes and edges of one file per part ({path})."
    query(name, sql)(run)


_register(
    "parse_python",
    "src/p{k}.py",
    "import os\nfrom m.n import foo\n\nclass P{k}(Base):\n    def run(self):\n        self.stop()\n        foo({k})\n\n    def stop(self):\n"
    "        return os.getcwd()\n\ndef helper{k}(x):\n    # helper(9)\n    return foo(x)\n",
    [
        ("node", "src/p{k}.py", "File", ""),
        ("node", "Class:src/p{k}.py:P{k}:", "Class", "4-10"),
        ("node", "Function:src/p{k}.py:P{k}.run:", "Function", "5-7"),
        ("node", "Function:src/p{k}.py:P{k}.stop:", "Function", "9-10"),
        ("node", "Function:src/p{k}.py:helper{k}:", "Function", "12-14"),
        ("edge", "Class:src/p{k}.py:P{k}:", "DEFINED_IN", "src/p{k}.py"),
        ("edge", "Function:src/p{k}.py:P{k}.run:", "DEFINED_IN", "src/p{k}.py"),
        ("edge", "Function:src/p{k}.py:P{k}.stop:", "DEFINED_IN", "src/p{k}.py"),
        ("edge", "Function:src/p{k}.py:helper{k}:", "DEFINED_IN", "src/p{k}.py"),
        ("edge", "Class:src/p{k}.py:P{k}:", "EXTENDS", "Class:src/p{k}.py:Base:"),
        ("edge", "Function:src/p{k}.py:P{k}.run:", "CALLS", "Function:src/p{k}.py:P{k}.stop:"),
        ("edge", "Function:src/p{k}.py:P{k}.run:", "CALLS", "Function:src/p{k}.py:m.n.foo:"),
        ("edge", "Function:src/p{k}.py:P{k}.stop:", "CALLS", "Function:src/p{k}.py:os.getcwd:"),
        ("edge", "Function:src/p{k}.py:helper{k}:", "CALLS", "Function:src/p{k}.py:m.n.foo:"),
    ],
)
_register(
    "parse_vb",
    "vb/p{k}.vb",
    "Namespace Shop\n  Public Class P{k}\n    Public Sub Run()\n      If (x) Then\n        Total{k}(1)\n      End If\n    End Sub\n\n"
    "    Private Function Total{k}(a)\n      Return Rate(a)\n    End Function\n  End Class\nEnd Namespace\n",
    [
        ("node", "vb/p{k}.vb", "File", ""),
        ("node", "Shop.P{k}", "Class", "2-12"),
        ("node", "Shop.P{k}.Run", "Function", "3-7"),
        ("node", "Shop.P{k}.Total{k}", "Function", "9-11"),
        ("edge", "Shop.P{k}", "DEFINED_IN", "vb/p{k}.vb"),
        ("edge", "Shop.P{k}.Run", "DEFINED_IN", "vb/p{k}.vb"),
        ("edge", "Shop.P{k}.Total{k}", "DEFINED_IN", "vb/p{k}.vb"),
        ("edge", "Shop.P{k}", "HAS_METHOD", "Shop.P{k}.Run"),
        ("edge", "Shop.P{k}", "HAS_METHOD", "Shop.P{k}.Total{k}"),
        ("edge", "Shop.P{k}.Run", "CALLS", "Total{k}"),
        ("edge", "Shop.P{k}.Total{k}", "CALLS", "Rate"),
    ],
)
_register(
    "parse_sql",
    "db/p{k}.sql",
    "CREATE FUNCTION price{k}(a int) RETURNS int AS $$\n  SELECT a * 2; -- old{k}(1), isn't\n$$ LANGUAGE sql;\n\n"
    "CREATE OR REPLACE FUNCTION total{k}() RETURNS int AS $$\nBEGIN /* one(1) /* two(2) */ three(3) */\n  RETURN price{k}(1) + length{k}('four(4) ''five(5)'''); -- six(6)\nEND;\n$$ LANGUAGE plpgsql;\n",
    [
        ("node", "db/p{k}.sql", "File", ""),
        ("node", "Function:db/p{k}.sql:price{k}:", "Function", "1-3"),
        ("node", "Function:db/p{k}.sql:total{k}:", "Function", "5-9"),
        ("edge", "Function:db/p{k}.sql:price{k}:", "DEFINED_IN", "db/p{k}.sql"),
        ("edge", "Function:db/p{k}.sql:total{k}:", "DEFINED_IN", "db/p{k}.sql"),
        ("edge", "Function:db/p{k}.sql:total{k}:", "CALLS", "db/p{k}.sql:price{k}"),
        ("edge", "Function:db/p{k}.sql:total{k}:", "CALLS", "db/p{k}.sql:length{k}"),
    ],
)
_register(
    "parse_cs",
    "cs/p{k}.cs",
    "using Shop.Core;\n\nnamespace Shop.App\n{\n    public class P{k} : Base\n    {\n        private readonly ILogger _log;\n\n"
    "        public P{k}(ILogger log) { _log = log; }\n\n        public void Run(int a, List<string> b)\n        {\n            _log.Write(\"x(\");\n"
    "            Stop();\n        }\n    }\n}\n",
    [
        ("node", "cs/p{k}.cs", "File", ""),
        ("node", "Class:Shop.App.P{k}:", "Class", "5-16"),
        ("node", "Field:Shop.App.P{k}._log:", "Field", "7-7"),
        ("node", "Function:Shop.App.P{k}.P{k}:(ILogger)", "Function", "9-9"),
        ("node", "Function:Shop.App.P{k}.Run:(int, List<string>)", "Function", "11-15"),
        ("edge", "Class:Shop.App.P{k}:", "DEFINED_IN", "cs/p{k}.cs"),
        ("edge", "Function:Shop.App.P{k}.P{k}:(ILogger)", "DEFINED_IN", "cs/p{k}.cs"),
        ("edge", "Function:Shop.App.P{k}.Run:(int, List<string>)", "DEFINED_IN", "cs/p{k}.cs"),
        ("edge", "Class:Shop.App.P{k}:", "INHERITS", "Shop.App.Base"),
        ("edge", "Class:Shop.App.P{k}:", "INHERITS", "Shop.Core.Base"),
        ("edge", "Class:Shop.App.P{k}:", "DEPENDS_ON", "Shop.App.ILogger"),
        ("edge", "Class:Shop.App.P{k}:", "DEPENDS_ON", "Shop.Core.ILogger"),
        ("edge", "Class:Shop.App.P{k}:", "DEPENDS_ON", "Shop.App.ILogger"),
        ("edge", "Class:Shop.App.P{k}:", "DEPENDS_ON", "Shop.Core.ILogger"),
        ("edge", "Function:Shop.App.P{k}.Run:(int, List<string>)", "CALLS", "Shop.App.ILogger.Write"),
        ("edge", "Function:Shop.App.P{k}.Run:(int, List<string>)", "CALLS", "Shop.Core.ILogger.Write"),
        ("edge", "Function:Shop.App.P{k}.Run:(int, List<string>)", "CALLS", "Shop.App.Stop"),
        ("edge", "Function:Shop.App.P{k}.Run:(int, List<string>)", "CALLS", "Shop.Core.Stop"),
    ],
)
_register(
    "parse_java",
    "java/P{k}.java",
    "package shop;\n\nimport shop.core.Store;\n\npublic class P{k} extends Base implements Runnable {\n    private Store store;\n\n"
    "    public P{k}(Store store) {\n        this.store = store;\n    }\n\n    @Override\n    public void run() {\n        store.save(1);\n"
    "        stop();\n        Item i = new Item();\n    }\n\n    void stop() { }\n}\n",
    [
        ("node", "java/P{k}.java", "File", ""),
        ("node", "Class:shop.P{k}:", "Class", "5-20"),
        ("node", "Field:shop.P{k}.store:", "Field", "6-6"),
        ("node", "Constructor:shop.P{k}.P{k}:(Store)", "Constructor", "8-10"),
        ("node", "Function:shop.P{k}.run:()", "Function", "13-17"),
        ("node", "Function:shop.P{k}.stop:()", "Function", "19-19"),
        ("edge", "Class:shop.P{k}:", "DEFINED_IN", "java/P{k}.java"),
        ("edge", "Function:shop.P{k}.run:()", "DEFINED_IN", "java/P{k}.java"),
        ("edge", "Function:shop.P{k}.stop:()", "DEFINED_IN", "java/P{k}.java"),
        ("edge", "Class:shop.P{k}:", "EXTENDS", "shop.Base"),
        ("edge", "Class:shop.P{k}:", "IMPLEMENTS", "shop.Runnable"),
        ("edge", "Class:shop.P{k}:", "DEFINES", "Field:shop.P{k}.store:"),
        ("edge", "Class:shop.P{k}:", "DEPENDS_ON", "shop.core.Store"),
        ("edge", "Class:shop.P{k}:", "DEPENDS_ON", "shop.core.Store"),
        ("edge", "Class:shop.P{k}:", "HAS_METHOD", "Constructor:shop.P{k}.P{k}:(Store)"),
        ("edge", "Class:shop.P{k}:", "HAS_METHOD", "Function:shop.P{k}.run:()"),
        ("edge", "Class:shop.P{k}:", "HAS_METHOD", "Function:shop.P{k}.stop:()"),
        ("edge", "Function:shop.P{k}.run:()", "CALLS", "shop.core.Store.save"),
        ("edge", "Function:shop.P{k}.run:()", "CALLS", "shop.P{k}.stop"),
        ("edge", "Function:shop.P{k}.run:()", "CALLS", "shop.Item"),
    ],
)
_register(
    "parse_ts",
    "ts/p{k}.ts",
    "import { Store as S, Log } from './lib/store';\n\nexport class P{k} extends S {\n    private log: Log;\n\n    constructor(\n        private store: S,\n"
    "    ) {\n        super(store);\n    }\n\n    run(n: number): void {\n        this.log.write(n);\n        this.stop();\n    }\n\n    stop() { done(); }\n}\n\n"
    "const make{k} = (a: string) => {\n    return new P{k}(a);\n};\n",
    [
        ("node", "ts/p{k}.ts", "File", ""),
        ("node", "Class:ts/p{k}.ts:P{k}:", "Class", "3-18"),
        ("node", "Field:ts/p{k}.ts:P{k}.log:", "Field", "4-4"),
        ("node", "Function:ts/p{k}.ts:P{k}.constructor:", "Function", "6-10"),
        ("node", "Function:ts/p{k}.ts:P{k}.run:", "Function", "12-15"),
        ("node", "Function:ts/p{k}.ts:P{k}.stop:", "Function", "17-17"),
        ("node", "Function:ts/p{k}.ts:make{k}:", "Function", "20-22"),
        ("edge", "Class:ts/p{k}.ts:P{k}:", "DEFINED_IN", "ts/p{k}.ts"),
        ("edge", "Function:ts/p{k}.ts:P{k}.constructor:", "DEFINED_IN", "ts/p{k}.ts"),
        ("edge", "Function:ts/p{k}.ts:P{k}.run:", "DEFINED_IN", "ts/p{k}.ts"),
        ("edge", "Function:ts/p{k}.ts:P{k}.stop:", "DEFINED_IN", "ts/p{k}.ts"),
        ("edge", "Function:ts/p{k}.ts:make{k}:", "DEFINED_IN", "ts/p{k}.ts"),
        ("edge", "Class:ts/p{k}.ts:P{k}:", "EXTENDS", "ts/lib/store.ts:Store"),
        ("edge", "Class:ts/p{k}.ts:P{k}:", "DEFINES", "Field:ts/p{k}.ts:P{k}.log:"),
        ("edge", "Class:ts/p{k}.ts:P{k}:", "DEPENDS_ON", "ts/lib/store.ts:Log"),
        ("edge", "Class:ts/p{k}.ts:P{k}:", "DEPENDS_ON", "ts/lib/store.ts:Store"),
        ("edge", "Function:ts/p{k}.ts:P{k}.run:", "CALLS", "ts/lib/store.ts:Log.write"),
        ("edge", "Function:ts/p{k}.ts:P{k}.run:", "CALLS", "ts/p{k}.ts:P{k}.stop"),
        ("edge", "Function:ts/p{k}.ts:P{k}.stop:", "CALLS", "ts/p{k}.ts:done"),
        ("edge", "Function:ts/p{k}.ts:make{k}:", "CALLS", "ts/p{k}.ts:P{k}"),
    ],
)
_register(
    "parse_asp",
    "web/p{k}.asp",
    "<%@ Language=\"VBScript\" %>\n<html><body>Run(1)\n<%\nSub Show{k}()\n  Response.Write(total({k}))\nEnd Sub\n%>\n<b><%= Show{k}() %></b>\n</body></html>\n",
    [
        ("node", "web/p{k}.asp", "File", ""),
        ("node", "AspWrapper", "Class", "0-12"),
        ("node", "AspWrapper.Show{k}", "Function", "4-7"),
        ("edge", "AspWrapper", "DEFINED_IN", "web/p{k}.asp"),
        ("edge", "AspWrapper.Show{k}", "DEFINED_IN", "web/p{k}.asp"),
        ("edge", "AspWrapper", "HAS_METHOD", "AspWrapper.Show{k}"),
        ("edge", "AspWrapper.Show{k}", "CALLS", "Write"),
        ("edge", "AspWrapper.Show{k}", "CALLS", "total"),
    ],
)
# A location without a file is in the file named last before it: h, helper and all up to f are of the header, what follows f is of the source again.
_register(
    "parse_cpp",
    "/repo/cpp/p{k}.cpp",
    '{"kind":"TranslationUnitDecl","id":"1","inner":[{"kind":"VarDecl","id":"2","name":"g{k}","loc":{"line":1}},'
    '{"kind":"FunctionDecl","id":"20","name":"printf","loc":{"file":"/usr/include/stdio.h","line":9}},{"kind":"FunctionDecl","id":"21","name":"scanf{k}","loc":{"line":19}},'
    '{"kind":"NamespaceDecl","id":"23","name":"sys","loc":{"line":20},"inner":[{"kind":"FunctionDecl","id":"24","name":"own{k}","loc":{"line":21}}]},'
    '{"kind":"FunctionDecl","id":"22","name":"h{k}","loc":{"file":"/repo/inc/h{k}.h","line":7,"includedFrom":{"file":"/repo/cpp/p{k}.cpp"}}},'
    '{"kind":"FunctionDecl","id":"25","name":"helper{k}","loc":{"line":8},"range":{"begin":{"line":8},"end":{"line":9}}},{"kind":"FunctionDecl","id":"26","name":"_own{k}","loc":{"line":9}},'
    '{"kind":"CXXRecordDecl","id":"27","name":"H{k}","completeDefinition":true,"loc":{"line":10},"inner":[{"kind":"CXXMethodDecl","id":"28","name":"get","loc":{"line":11}},'
    '{"kind":"FieldDecl","id":"29","name":"all","type":{"qualType":"List<n::D>"},"loc":{"line":12}}]},'
    '{"kind":"FunctionDecl","id":"3","name":"f{k}","type":{"qualType":"int (int, char)"},"loc":{"file":"/repo/cpp/p{k}.cpp","line":2},"range":{"begin":{},"end":{"line":4}},'
    '"inner":[{"kind":"ParmVarDecl","id":"31","type":{"qualType":"int"}},{"kind":"ParmVarDecl","id":"32","type":{"qualType":"char"}},'
    '{"kind":"CompoundStmt","id":"4","inner":[{"kind":"DeclRefExpr","id":"5","referencedDecl":{"id":"2","kind":"VarDecl"}}]}]},'
    '{"kind":"NamespaceDecl","id":"60","name":"n","inner":[{"kind":"CXXRecordDecl","id":"6","name":"C{k}","completeDefinition":true,"loc":{"line":5},'
    '"bases":[{"type":{"qualType":"n::B"}},{"type":{"qualType":"std::string"}},{"type":{"qualType":"Base<int>"}}],"inner":[{"kind":"FieldDecl","id":"61","name":"d","type":{"qualType":"n::D *"},"loc":{"line":5}},'
    '{"kind":"CXXMethodDecl","id":"7","name":"run","type":{"qualType":"void ()"},"loc":{"line":6},"inner":[{"kind":"CallExpr","id":"8","inner":[{"kind":"ImplicitCastExpr","id":"9","inner":'
    '[{"kind":"DeclRefExpr","id":"10","referencedDecl":{"id":"3","kind":"FunctionDecl"}}]}]},{"kind":"CallExpr","id":"11","inner":[{"kind":"ImplicitCastExpr","id":"12","inner":'
    '[{"kind":"DeclRefExpr","id":"13","referencedDecl":{"id":"20","kind":"FunctionDecl"}}]}]},{"kind":"CallExpr","id":"14","inner":[{"kind":"ImplicitCastExpr","id":"15","inner":'
    '[{"kind":"DeclRefExpr","id":"16","referencedDecl":{"id":"25","kind":"FunctionDecl"}}]}]}]}]}]}]}',
    [
        ("node", "File:cpp/p{k}.cpp", "File", ""),
        ("node", "File:inc/h{k}.h", "File", ""),
        ("node", "Global:g{k}", "Global", "1"),
        ("node", "Function:h{k}:()", "Function", "7-7"),
        ("node", "Function:helper{k}:()", "Function", "8-9"),
        ("node", "Class:H{k}", "Class", "10-10"),
        ("node", "Function:H{k}::get:()", "Function", "11-11"),
        ("node", "Field:H{k}::all", "Field", "12"),
        ("node", "Function:f{k}:(int,char)", "Function", "2-4"),
        ("node", "Class:n::C{k}", "Class", "5-5"),
        ("node", "Field:n::C{k}::d", "Field", "5"),
        ("node", "Function:n::C{k}::run:()", "Function", "6-6"),
        ("edge", "Global:g{k}", "DEFINED_IN", "File:cpp/p{k}.cpp"),
        ("edge", "Function:h{k}:()", "DEFINED_IN", "File:inc/h{k}.h"),
        ("edge", "Function:helper{k}:()", "DEFINED_IN", "File:inc/h{k}.h"),
        ("edge", "Class:H{k}", "DEFINED_IN", "File:inc/h{k}.h"),
        ("edge", "Function:H{k}::get:()", "DEFINED_IN", "File:inc/h{k}.h"),
        ("edge", "Class:H{k}", "HAS_METHOD", "Function:H{k}::get:()"),
        ("edge", "Class:H{k}", "DEFINES", "Field:H{k}::all"),
        ("edge", "Function:f{k}:(int,char)", "DEFINED_IN", "File:cpp/p{k}.cpp"),
        ("edge", "Class:n::C{k}", "DEFINED_IN", "File:cpp/p{k}.cpp"),
        ("edge", "Function:n::C{k}::run:()", "DEFINED_IN", "File:cpp/p{k}.cpp"),
        ("edge", "Class:n::C{k}", "HAS_METHOD", "Function:n::C{k}::run:()"),
        ("edge", "Class:n::C{k}", "DEFINES", "Field:n::C{k}::d"),
        ("edge", "Class:n::C{k}", "DEPENDS_ON", "Class:n::D"),
        ("edge", "Class:n::C{k}", "INHERITS", "Class:n::B"),
        ("edge", "Function:n::C{k}::run:()", "CALLS", "Function:f{k}:(int,char)"),
        ("edge", "Function:n::C{k}::run:()", "CALLS", "Function:helper{k}:()"),
        ("edge", "Function:f{k}:(int,char)", "USES_GLOBAL", "Global:g{k}"),
    ],
)
