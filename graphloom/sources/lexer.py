"""Comments and strings of source text, found by one automaton over a stack of what is open.

The stack tells code in code: a comment within a comment, an expression within a string, a string within that expression, a
quoted body within a script. A text is passed once. What is found is blanked, line breaks stay, so that every
other character keeps its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Text:
    """A kind of string: how it opens, how it closes, and what stands within."""

    opens: str
    #: A pattern; ``{0}`` stands for what the opening matched.
    closes: str
    escape: str = r"\\."
    lines: bool = False
    #: How an expression within the string opens and closes, and what looks like an opening but is none.
    hole: tuple[str, str] | None = None
    no_hole: str = "(?!)"
    #: Whether its content is code, as the body of a routine is; only where no such text is open.
    body: bool = False
    #: Whether it is a name, which stays.
    name: bool = False


@dataclass(frozen=True)
class Syntax:
    line: str
    block: tuple[str, str] | None
    texts: tuple[Text, ...]
    nested: bool = False
    #: Whether a slash where a value may stand begins a pattern.
    patterns: bool = False


_NEVER = "(?!)"
_SINGLE, _DOUBLE = Text("'", "'"), Text('"', '"')
_C = ("/\\*", "\\*/")
SYNTAX = {
    "java": Syntax("//", _C, (Text('"""', '"""', lines=True), _SINGLE, _DOUBLE)),
    "cs": Syntax(
        "//", _C,
        (
            Text('"{3,}', "{0}", escape=_NEVER, lines=True), Text('(?:\\$@|@\\$)"', '"(?!")', escape='""', lines=True, hole=("\\{", "}"), no_hole="\\{\\{"), Text('@"', '"(?!")', escape='""', lines=True),
            Text('\\$"', '"', hole=("\\{", "}"), no_hole="\\{\\{"), _SINGLE, _DOUBLE,
        ),
    ),
    "ts": Syntax("//", _C, (Text("`", "`", lines=True, hole=("\\$\\{", "}")), _SINGLE, _DOUBLE), patterns=True),
    "python": Syntax(
        "#", None,
        tuple(
            text
            for quote in ('"""', "\'\'\'", '"', "'")
            for text in (
                Text(f"\\b(?i:f|fr|rf){quote}", quote, lines=len(quote) == 3, hole=("\\{", "}"), no_hole="\\{\\{"), Text(quote, quote, lines=len(quote) == 3),
            )
        ),
    ),
    "sql": Syntax(
        "--", _C,
        (
            Text("\\b[Ee]'", "'(?!')", escape="\\\\.|''", lines=True), Text("'", "'(?!')", escape="''", lines=True), Text('"', '"', escape='""', lines=True, name=True),
            Text("\\$(?:[A-Za-z_]\\w*)?\\$", "{0}", escape=_NEVER, lines=True, body=True),
        ),
        nested=True,
    ),
}
# Before a pattern stands an operator, an opening bracket, or one of these words; before a division, a value.
_BEFORE_PATTERN = re.compile(r"(?:[=(,:;!&|?{}\[+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))\s*\Z")
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_SHOWN_BEFORE = 40


class Lexer:
    """The automaton of one language; made once for each task."""

    def __init__(self, syntax: Syntax):
        self.syntax = syntax
        marks = [f"(?P<line>{syntax.line})", *([f"(?P<block>{syntax.block[0]})"] if syntax.block else [])]
        marks += [f"(?P<t{i}>{t.opens})" for i, t in enumerate(syntax.texts)]
        marks += ["(?P<slash>/)"] if syntax.patterns else []
        self.code = re.compile("|".join([*marks, r"(?P<open>\{)", r"(?P<shut>\})"]))
        self.block = re.compile("|".join(f"({x})" for x in syntax.block)) if syntax.block else None
        self.known: dict[str, re.Pattern] = {}

    def _inside(self, text: Text, opening: str) -> re.Pattern:
        closes = text.closes.format(re.escape(opening)) if "{0}" in text.closes else text.closes
        key = f"{text.opens} {closes}"
        if key not in self.known:
            hole = [f"(?P<plain>{text.no_hole})", f"(?P<hole>{text.hole[0]})"] if text.hole else []
            end = [] if text.lines else [r"(?P<end>\n)"]
            self.known[key] = re.compile("|".join([f"(?P<escape>{text.escape})", *hole, f"(?P<close>{closes})", *end]), re.DOTALL)
        return self.known[key]

    def spans(self, source: str) -> Iterator[tuple[int, int, bool]]:
        """Start, end, and whether it is a comment, of all that is no code, in order."""
        # Of what is open: code within a string (how many brackets it has open), a body (what closes it), or a string.
        stack: list[list] = [["code", 0, None]]
        at, size = 0, len(source)
        while at < size:
            kind, *held = stack[-1]
            if kind == "text":
                text, inside = held
                m = inside.search(source, at)
                # A string of one line ends with it, whatever it says; one that never ends holds the rest.
                while m and m.lastgroup in ("escape", "plain"):
                    m = inside.search(source, m.end())
                stop = m.start() if m else size
                if m and m.lastgroup == "close" and text.lines:
                    # Of a mark of several characters the last one stays: it may begin a line, which is no line of code.
                    stop = m.end() - 1
                if m and m.lastgroup == "hole":
                    stop = m.end()
                    stack.append(["code", 0, text])
                else:
                    stack.pop()
                if stop > at and not text.name:
                    yield at, stop, False
                at = m.end() if m else size
                continue
            body = held[1] if kind == "body" else None
            m = (body or self.code).search(source, at)
            if m is None:
                return
            found, at = m.lastgroup, m.end()
            if found == "close":
                stack.pop()
            elif found == "line":
                end = source.find("\n", at)
                end = size if end < 0 else end
                yield m.start(), end, True
                at = end
            elif found == "block":
                depth = 1
                for b in self.block.finditer(source, at):
                    depth += (1 if self.syntax.nested else 0) if b[1] else -1
                    if not depth:
                        at = b.end()
                        break
                else:
                    at = size
                yield m.start(), at, True
            elif found == "open":
                stack[-1][1] += 1 if kind == "code" else 0
            elif found == "shut":
                if kind == "code" and stack[-1][1] == 0 and held[1] is not None:
                    stack.pop()
                    yield m.start(), at, False
                elif kind == "code":
                    stack[-1][1] -= 1
            elif found == "slash":
                before = source[max(0, m.start() - _SHOWN_BEFORE) : m.start()].rstrip(" \t")
                whole = _PATTERN.match(source, m.start())
                if whole and (not before.strip() or _BEFORE_PATTERN.search(before)):
                    yield m.start() + 1, whole.end() - 1, False
                    at = whole.end()
            else:
                text = self.syntax.texts[int(found[1:])]
                opening = m[0]
                if text.body and not any(s[0] == "body" for s in stack):
                    # A body is code up to its own mark; quotes of the same kind within it are strings.
                    close = re.compile(f"(?P<close>{re.escape(opening)})|{self.code.pattern}")
                    stack.append(["body", 0, close])
                else:
                    stack.append(["text", text, self._inside(text, opening)])

    def blanked(self, source: str) -> tuple[str, str]:
        """The text without comments, and without what strings hold either."""
        kept, code, at = [], [], 0
        for start, end, comment in self.spans(source):
            blank = re.sub(r"[^\r\n]", " ", source[start:end])
            kept += [source[at:start], blank if comment else source[start:end]]
            code += [source[at:start], blank]
            at = end
        return "".join([*kept, source[at:]]), "".join([*code, source[at:]])


def without_comments(files: DataFrame, lang: str) -> DataFrame:
    """``(path, lang, text, code)`` of ``files(path, lang, text)`` of one language, in one pass over each."""
    if lang not in SYNTAX:
        return files.selectExpr("path", "lang", "text", "text as code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(SYNTAX[lang])
        for batch in batches:
            both = [(None, None) if t is None else lexer.blanked(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([b[i] for b in both], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["path", "lang", "text", "code"])

    return files.select("path", "lang", "text").mapInArrow(run, "path string, lang string, text string, code string")
