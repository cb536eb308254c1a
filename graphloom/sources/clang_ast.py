"""Syntax trees dumped by a C++ compiler as JSON, one document per translation unit.

A task pulls a dump through once, member by member, and keeps only the path from the root to where it is:
scopes, the enclosing class and function, and the file and line last stated. No subtree is held, so that
a dump may have any size; what it yields are facts, namely declarations and references, which
Spark joins to a graph. Memory is bounded by the depth of the tree and by the references of one function.

A dump names a file only where it changes from one location to the next, in the order of the text; a location
without a file is in the file last named. A child of the root that lies outside the repository is passed over with all that is in it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, conform_nodes
from graphloom.session import cut, sorted_join

# Node kinds by what they declare.
CLASSES = ["CXXRecordDecl"]
FUNCTIONS = ["FunctionDecl", "CXXMethodDecl", "CXXDestructorDecl"]
CONSTRUCTORS = ["CXXConstructorDecl"]
MEMBERS = ["CXXMethodDecl", "CXXDestructorDecl", "CXXConstructorDecl"]
NAMESPACES = ["NamespaceDecl"]
CALLS = ["CallExpr", "CXXMemberCallExpr"]
WRAPPERS = ["ImplicitCastExpr"]
# Storage of a variable that is no local one.
SHARED_STORAGE = ["", "static", "extern"]
# Types that are no class of the code.
PLAIN_TYPES = [
    "int", "char", "float", "double", "bool", "void", "unsigned", "signed", "long", "short", "size_t", "wchar_t",
    "BOOL", "DWORD", "UINT", "LONG", "WORD", "BYTE", "LPCTSTR", "LPCSTR", "CString", "HRESULT",
]
LABELS = dict.fromkeys(CLASSES, "Class") | dict.fromkeys(FUNCTIONS, "Function") | dict.fromkeys(CONSTRUCTORS, "Constructor") | {"FieldDecl": "Field", "VarDecl": "Global"}
#: Members of a node that are read; all others are passed over.
READ = {"kind", "id", "name", "loc", "range", "isImplicit", "completeDefinition", "storageClass", "type", "bases", "referencedDecl", "referencedMemberDecl"}
#: Facts sent to Spark at once.
FACTS = 5000
# Dumps up to this many characters are decoded at once and walked then; longer ones are pulled through.
WHOLE = 1 << 18
# Dumps, and characters of them, that one task reads: small dumps in many tasks would cost each later step as many.
DUMPS = 20_000
CHARACTERS = 64_000_000

FACT = (
    "path string, at long, label string, kind string, name string, fqn string, id string, file string, start_line long, end_line long,"
    " in_class string, declared string, bases array<string>, decl string, user string, refers string, callee boolean, unread string"
)

_FIRST = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"\s*:\s*|\})')
_NEXT = re.compile(r'\s*(?:,\s*"((?:[^"\\]|\\.)*)"\s*:\s*|\})')
_ITEM = re.compile(r"\s*(?:\](?P<end>)|(?P<comma>,)?\s*(?P<object>\{)?)")
_VALUE = json.JSONDecoder().raw_decode


class _Places:
    """The file and line last stated, in the order of the text."""

    def __init__(self, path: str):
        self.file, self.line = path, None

    def see(self, place: dict) -> tuple[str, int | None]:
        """File and line of a location; of one within a macro, of where the macro stands. A location that says nothing has no line."""
        if "spellingLoc" in place or "expansionLoc" in place:
            inside = self.see(place.get("spellingLoc") or {})
            return self.see(place["expansionLoc"]) if place.get("expansionLoc") else inside
        self.file = place.get("file") or self.file
        if "line" in place:
            self.line = place["line"]
        return self.file, self.line if place.keys() & {"line", "col", "offset"} else None


class _Node:
    """A node on the path from the root: what it hands down to its children, and what its facts wait for."""

    __slots__ = ("head", "above", "entered", "passed", "scope", "in_class", "owner", "callee", "children", "fact", "parameters", "uses")

    def __init__(self, above: _Node | None):
        self.head, self.above, self.entered, self.children, self.fact, self.parameters, self.uses = {}, above, False, 0, None, None, None


class _Walk:
    """One pass over a dump; yields facts as dictionaries."""

    def __init__(self, path: str, base: str):
        self.path, self.base, self.places, self.count = path, base.lower(), _Places(path), 0

    def inside(self, file: str) -> bool:
        return file.replace("\\", "/").lower().startswith(self.base)

    def facts(self, text: str) -> Iterator[dict]:
        """Facts of a dump; one that is short and whole is walked as a tree, which gives the same."""
        if len(text or "") <= WHOLE:
            try:
                tree = json.loads(text or "")
            except (ValueError, RecursionError):
                tree = None
            if isinstance(tree, dict):
                yield from self.tree(tree)
                return
        yield from self.pulled(text)

    def tree(self, tree: dict) -> Iterator[dict]:
        """The walk of ``pulled`` over a decoded dump. Each node is entered where its first list ``inner`` stands."""
        node, lists = None, [iter([tree])]
        while lists:
            value = next(lists[-1], lists)
            if value is lists:
                lists.pop()
                if lists:
                    yield from self.leave(node)
                    node = node.above
                continue
            if not isinstance(value, dict):
                node.children += 1
                continue
            node, inner = _Node(node), ()
            for name, member in value.items():
                if name == "inner" and isinstance(member, list):
                    inner = member
                    break
                if name in READ:
                    node.head[name] = member
            self.enter(node)
            lists.append(iter(inner))

    def pulled(self, text: str) -> Iterator[dict]:
        start = re.compile(r"\s*\{").match(text or "")
        if not start:
            raise ValueError("no object")
        at, node, member = start.end(), _Node(None), _FIRST
        while True:
            found = member.match(text, at)
            if not found:
                raise ValueError(f"no member at {at}")
            at = found.end()
            if found[1] is None:
                if not node.entered:
                    self.enter(node)
                yield from self.leave(node)
                node = node.above
                if node is None:
                    if text[at:].strip():
                        raise ValueError(f"text after the tree at {at}")
                    return
            elif found[1] == "inner" and text.startswith("[", at) and not node.entered:
                at += 1
                self.enter(node)
            else:
                value, at = _VALUE(text, at)
                if found[1] in READ:
                    node.head[found[1]] = value
                member = _NEXT
                continue
            # After an object of a list, or at the start of a list: the next object, or the end of the list.
            while True:
                item = _ITEM.match(text, at)
                if item["end"] is not None:
                    at, member = item.end(), _NEXT
                    break
                if bool(item["comma"]) != (node.children > 0):
                    raise ValueError(f"no item at {at}")
                if item["object"]:
                    at, node, member = item.end(), _Node(node), _FIRST
                    break
                _, at = _VALUE(text, item.end())
                node.children += 1

    def enter(self, node: _Node) -> None:
        """All that a node says of itself is read: place it, name it and say what holds for its children."""
        head, above = node.head, node.above
        node.entered, kind, name = True, head.get("kind") or "", head.get("name") or ""
        file, line = self.places.see(head.get("loc") or {})
        span = head.get("range") or {}
        begin, end = self.places.see(span.get("begin") or {})[1], self.places.see(span.get("end") or {})[1]
        if above is None:
            node.passed, node.scope, node.in_class, node.owner, node.callee = False, "", "", None, False
            return
        nth, above.children = above.children, above.children + 1
        node.passed = above.passed or bool(head.get("isImplicit")) or (above.above is None and not self.inside(file))
        node.scope, node.in_class, node.owner = above.scope, above.in_class, above.owner
        node.callee = (nth == 0 and above.head.get("kind") in CALLS) or (above.callee and above.head.get("kind") in WRAPPERS)
        if node.passed:
            return
        if kind == "ParmVarDecl" and above.parameters is not None:
            above.parameters.append((head.get("type") or {}).get("qualType") or "")
        refers = (head.get("referencedDecl") or {}).get("id") or head.get("referencedMemberDecl")
        if refers and node.owner:
            node.owner.uses[refers, node.callee] = True
        named = bool(name) and (kind in LABELS or kind in NAMESPACES)
        if not named:
            return
        fqn = f"{above.scope}::{name}" if above.scope else name
        node.scope = fqn
        known = kind in LABELS and not (fqn.startswith("std::") or "::std::" in fqn or name.startswith("_")) and self.inside(file)
        if kind in CLASSES:
            known = known and bool(head.get("completeDefinition"))
            node.in_class = f"Class:{fqn}" if known else ""
        if kind == "VarDecl" and (head.get("storageClass") or "") not in SHARED_STORAGE:
            known = False
        # What a function declares inside is local.
        known = known and node.owner is None
        routine = kind in FUNCTIONS or kind in CONSTRUCTORS
        if known:
            self.count += 1
            start = line if line is not None else begin
            last = end if end is not None else start
            node.fact = {
                "path": self.path, "at": self.count, "label": LABELS[kind], "kind": kind, "name": name, "fqn": fqn, "id": f"{LABELS[kind]}:{fqn}", "file": file,
                "start_line": start, "end_line": last if routine or kind in CLASSES else None, "in_class": above.in_class,
                "declared": (head.get("type") or {}).get("qualType") or "", "decl": head.get("id"),
                "bases": [b for b in ((x.get("type") or {}).get("qualType") for x in head.get("bases") or []) if b],
            }
        if routine:
            # Nothing below a function that is no part of the graph counts.
            node.passed = not known
            if known:
                node.owner, node.parameters, node.uses = node, [], {}

    def leave(self, node: _Node) -> Iterator[dict]:
        """A declaration is known when its parameters are, at its end; then its references follow."""
        if node.fact is None:
            return
        if node.parameters is not None:
            node.fact["id"] += f":({','.join(node.parameters)})"
        yield node.fact
        for refers, callee in node.uses or ():
            yield {"path": self.path, "user": node.fact["id"], "refers": refers, "callee": callee}


def tree_facts(files: DataFrame, root: str = "") -> DataFrame:
    """``FACT`` of every dump of ``files(path, text)``: declarations (with a ``label``), references (``refers``), and why a dump could not be read to its end (``unread``)."""
    base = _base(root)

    def rows(path: str, text: str | None) -> Iterator[dict]:
        try:
            yield from _Walk(path, base).facts(text)
        except ValueError as problem:
            yield {"path": path, "unread": str(problem)[:200]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = _fact_schema(), []
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for fact in rows(path, text.as_py()):
                    held.append(fact)
                    if len(held) == FACTS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("path", "text").mapInArrow(run, FACT)


def _fact_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in FACT.split(", "))])


def unread_trees(files: DataFrame) -> DataFrame:
    """``(path)`` of dumps that could not be read to their end; what they declare before that is in the graph."""
    return tree_facts(files).where("unread is not null").select("path").distinct()


def _base(root: str) -> str:
    return root.replace("\\", "/").rstrip("/")


def _shown(path: Column, base: str) -> Column:
    """A path relative to the root."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.lit(bool(base)) & F.lower(clean).startswith(base.lower() + "/")
    return F.when(inside, F.substring(clean, len(base) + 2, 1 << 30)).otherwise(clean)


def _dealt(dumps: DataFrame) -> DataFrame:
    """Dumps dealt out by path, to no more tasks than their number and length ask for."""
    size = dumps.agg(F.count(F.lit(1)), F.sum(F.length("text").cast("long"))).first()
    tasks = max(dumps.sparkSession.sparkContext.defaultParallelism, math.ceil(size[0] / DUMPS), math.ceil((size[1] or 0) / CHARACTERS))
    return dumps.repartition(tasks, "path")


def extract_trees(files: DataFrame, root: str = "") -> PropertyGraph:
    """Unresolved graph of ``files(path, text)``; ``path`` is the source file of each tree.

    A line is known where the dump states it; an end that is not stated is the start. Of declarations
    with one id the first stands, by path and place. References to names of the standard library
    have no declaration in the graph and fall out.
    """
    base = _base(root)
    facts = cut(tree_facts(_dealt(files.select("path", "text")), root).withColumn("file", _shown(F.col("file"), base)))
    decls = facts.where("label is not null")
    shown = ["label", "name", "fqn", "file", "start_line", "end_line"]
    code = decls.groupBy("id").agg(F.min_by(F.struct(*shown), F.struct("path", "at")).alias("first")).select("id", *(f"first.{c}" for c in shown))
    # Every dump has its file, also one that could not be read.
    units = files.select(_shown(F.col("path"), base).alias("file"))
    file_nodes = decls.select("file").unionByName(units).distinct().select(
        F.concat(F.lit("File:"), "file").alias("id"), F.lit("File").alias("label"), F.col("file").alias("name"), "file"
    )
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    c = F.col
    homes = edge(decls.where("label <> 'Field'"), c("id"), F.concat(F.lit("File:"), "file"), "DEFINED_IN")
    owned = decls.where("in_class <> ''")
    methods = edge(owned.where(c("kind").isin(MEMBERS)), c("in_class"), c("id"), "HAS_METHOD")
    fields = edge(owned.where("label = 'Field'"), c("in_class"), c("id"), "DEFINES")
    held = F.trim(F.regexp_replace(F.regexp_replace("declared", "\\b(?:const|volatile|struct|class|enum)\\b", ""), "[*&\\[\\]0-9]+\\s*\\z", ""))
    # A type made from a template names no class of the graph.
    of_class = lambda t: (t != "") & ~t.startswith("std::") & ~t.contains("<") & ~F.substring_index(t, " ", 1).isin(PLAIN_TYPES)
    typed = owned.where("label = 'Field'").select("in_class", held.alias("held")).where(of_class(c("held")))
    depends = edge(typed, c("in_class"), F.concat(F.lit("Class:"), "held"), "DEPENDS_ON")
    based = decls.where("label = 'Class'").select("id", F.explode("bases").alias("declared")).select("id", held.alias("base")).where(of_class(c("base")))
    inherits = edge(based, c("id"), F.concat(F.lit("Class:"), "base"), "INHERITS")

    targets = decls.select("path", c("decl").alias("refers"), c("id").alias("target"), c("label").alias("target_label"))
    used = sorted_join(facts.where("refers is not null").select("path", "refers", "callee", "user"), targets, ["path", "refers"])
    calls = edge(used.where(c("callee") & c("target_label").isin("Function", "Constructor")), c("user"), c("target"), "CALLS")
    shared = edge(used.where("target_label = 'Global'"), c("user"), c("target"), "USES_GLOBAL")
    edges = reduce(DataFrame.unionByName, [homes, methods, fields, inherits, depends, calls, shared]).distinct()
    return PropertyGraph(conform_nodes(code).unionByName(conform_nodes(file_nodes)), edges)
