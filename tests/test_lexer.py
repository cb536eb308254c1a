"""What the automaton takes for comments and strings, language by language."""

import re

import pytest
from frames import rows

from graphloom.sources.languages import extract
from graphloom.sources.lexer import SYNTAX, Lexer

# Calls whose number is odd are code, those with an even one are in a comment or a string.
SOURCES = {
    "sql": [
        "SELECT a(1) -- b(2)\n/* c(2) /* d(4) */ e(6) */ , 'f(2) ''g(4)''' , E'h\\'i(2)', \"My\"(5)",
        "CREATE FUNCTION x() AS $$ BEGIN a(1); $q$ b(2) ' $q$; -- c(2) $$ d(4)\n e(3); END $$; f(5)",
        "AS $body$ a(1) '$body' b(3) $body$ c(5)".replace("'$body'", "'$body x(2)'"),
        "'open a(2)\n b(4)", "/* open a(2)", "a(1) - b(3) / c(5)", "$$ a(1) $$ b(3) $$ c(5) $$",
    ],
    "ts": [
        "a(1); `b(2) ${c(3)} d(4)`; e(5)", "`${`${a(1)} b(2)`} c(4) { ${ {x: d(3)}.x } e(6)`; f(5)", "const r = /'[/(]a(2)/g; b(1); c = d / e(3) / f(5); // g(2)",
        "s.replace(/\\/'/, 'a(2)'); b(1)", "'a(2) \\' b(4)'; \"c(2)\"; d(1) /* e(2) */", "'never closed a(2)\nb(1)", "if (x) { a(1) } else { `}` }; b(3)", "return /a(2)/; f(1)",
    ],
    "python": [
        "f'{a(1)} {{b(2)}} {c[\"d(2)\"]}'; e(3)", "'''a(2)\n'b(4)''' + c(1)  # d(2)", 'x = rf"""{a(1)} b(2) " {c(3)}""" ; d(5)', "r'\\'a(2)' + b(1)", "'a(2)\nb(1)", "elf'a(2)'; b(1)",
    ],
    "cs": [
        '$"a(2) {b(1)} {{c(2)}} {d["e(2)"]}"', '@"C:\\" + a(1) // b(2)\nc(3)', '@"a(2) ""b(4)"" " + c(1)', '$@"a(2)\n{b(1)} "" c(4)"; d(3)', '"""a(2) " b(4) """; c(1)',
        "x = '\"'; b(1) /* c(2) /* */ + d(3)",
    ],
    "java": ['String s = """\n a(2) " b(4)\n"""; c(1);', "char c = '\"'; a(1); // b(2)", '"\\"a(2)"; b(1); /* c(2) \n d(4) */ e(3)'],
}


@pytest.mark.parametrize("lang, source", [(lang, s) for lang, many in SOURCES.items() for s in many])
def test_code_and_what_is_none(lang, source):
    kept, code = Lexer(SYNTAX[lang]).blanked(source)
    assert len(kept) == len(code) == len(source) and [i for i, c in enumerate(source) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
    called = lambda text: re.findall(r'[\w"]\((\d)\)', text)
    assert called(code) == [n for n in called(source) if int(n) % 2]


def test_comments_go_and_strings_stay_where_asked():
    kept, code = Lexer(SYNTAX["ts"]).blanked("import x from './m'; // no\n")
    assert kept == "import x from './m';      \n" and code == "import x from '   ';      \n"


def test_brackets_within_strings_do_not_count():
    _, code = Lexer(SYNTAX["ts"]).blanked("function f() { return `{ ${g({a: 1})} }`; }")
    assert code.count("{") == code.count("}") == 2


def calls(spark, path, text):
    g = extract(spark.createDataFrame([(path, text)], "path string, text string"))
    return {(re.split("[:.]", s.rstrip(":"))[-1], re.split("[:.]", d.rstrip(":"))[-1]) for s, d, t in rows(g.edges) if t == "CALLS"}


def test_sql_comments_and_strings_call_nothing(spark):
    text = "CREATE FUNCTION now_(a int) AS $$\nBEGIN\n  -- old(1)\n  PERFORM log('h(2)');\n  /* a(1) /* b(2) */ c(3) */\n  RETURN used(1);\nEND;\n$$;\n"
    assert calls(spark, "a.sql", text) == {("now_", "log"), ("now_", "used")}


def test_calls_within_template_literals(spark):
    text = "export function f() {\n  go(`a(1) ${inner(`b(2) ${deep(1)}`)} c(3)`);\n  const r = /'x(1)/;\n  last();\n}\n"
    assert calls(spark, "f.ts", text) == {("f", c) for c in ("go", "inner", "deep", "last")}


def test_calls_within_formatted_strings(spark):
    text = "def f(x):\n    return f'{used(x)} {{not_used(1)}} {x!r}'\n\ndef used(x):\n    return x\n"
    assert calls(spark, "a.py", text) == {("f", "used")}
