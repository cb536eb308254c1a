"""Property sheets that project files import, and what they set.

Each project is a row that carries an environment of variables, the statements still to come and what it has gathered.
All projects advance together: a task runs a project's statements until one needs a file, to import it
or to ask whether it exists; a join with the files at hand answers; the next round goes on from there. A sheet is
parsed once, whoever imports it, and rounds are as many as files the longest project asks for. Neither the files nor
the projects pass through the driver.

A sheet's properties and imports take effect in the order they are written, so that a sheet changes the environment of those
behind it and an import stands for the sheet's content; its compiler settings are read after its properties. A
sheet counts once in a project, which also ends cycles. A value is expanded where it is used, with what its variables are by then; a
reference to the property itself is expanded where it is set. Unknown names stay. Conditions of the sheets'
compiler settings are looked at only if ``strict``.
"""

from __future__ import annotations

import json
import posixpath
import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import broadcast_if_small, cut

# Variables of imports that belong to the tool chain and are not followed.
TOOL_VARIABLES = ("$(VCTargetsPath)", "$(UserRootDir)")
# Properties that hold a folder; relative ones are relative to their sheet, and they end in a slash.
FOLDER_PROPERTIES = ("RootProjectDir",)
# Marks of inherited values in lists.
INHERITED = {
    "includes": ("%(AdditionalIncludeDirectories)", "$(AdditionalIncludeDirectories)"), "defines": ("%(PreprocessorDefinitions)",), "options": (),
}
SETTINGS = {"AdditionalIncludeDirectories": "includes", "PreprocessorDefinitions": "defines", "AdditionalOptions": "options"}
# Short names of platforms; others are lower-cased.
PLATFORM_NAMES = {"Win32": "x86"}
#: A value is expanded again while it has known variables, so often at most.
EXPANSIONS = 10

_VARIABLE = re.compile(r"\$\(([^()]+)\)")
_TOKEN = re.compile(r"\s*(?:'([^']*)'|(==|!=|[!()])|([^\s'()=!]+))")

STATE = "path string, state string, need string"


def slashed(path: str) -> str:
    return path.replace("\\", "/")


def is_absolute(path: str) -> bool:
    return path.startswith("/") or re.match("[A-Za-z]:/", path) is not None


def placed(path: str, folder: str) -> str:
    """``path`` without steps up and down, seen from ``folder``."""
    path = slashed(path.strip())
    return posixpath.normpath(path if is_absolute(path) else f"{folder}/{path}")


def expand(text: str, variables: dict[str, str]) -> str:
    for _ in range(EXPANSIONS):
        more = _VARIABLE.sub(lambda m: variables.get(m[1], m[0]), text)
        if more == text:
            break
        text = more
    return text


def holds(condition: str, variables: dict[str, str], exists: Callable[[str], bool]) -> bool:
    """Whether a condition holds: comparisons of quoted texts (case counts for nothing), Exists('path'), !, And, Or, brackets.

    What is none of these holds, and so does no condition at all.
    """
    tokens = [m.groups() for m in _TOKEN.finditer(condition)]
    at = 0

    def take(*marks: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at][0] is None:
            mark = (tokens[at][1] or tokens[at][2]).lower()
            if mark in marks:
                at += 1
                return mark
        return None

    def value() -> str | None:
        nonlocal at
        if at < len(tokens) and (tokens[at][0] is not None or tokens[at][2]):
            at += 1
            return expand(tokens[at - 1][0] if tokens[at - 1][0] is not None else tokens[at - 1][2], variables)
        return None

    def atom() -> bool:
        if take("!"):
            return not atom()
        if take("("):
            found = either()
            take(")")
            return found
        if take("exists"):
            take("(")
            path = value()
            take(")")
            return path is None or exists(path)
        left = value()
        mark = take("==", "!=")
        if left is None or mark is None:
            return left is None or left.lower() != "false"
        return (left.lower() == (value() or "").lower()) == (mark == "==")

    def both() -> bool:
        found = atom()
        while take("and"):
            found = atom() and found
        return found

    def either() -> bool:
        found = both()
        while take("or"):
            found = both() or found
        return found

    return either() if tokens else True


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def statements(text: str | None, project: bool) -> list[list]:
    """What a file says, in order: ``import condition path``, ``set condition name value``, ``add condition settings``.

    Of a project file only the imports: its own settings are read as columns. A text that is no XML says nothing.
    """
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return []
    together = lambda *conditions: " And ".join(f"({c})" for c in conditions if c and c.strip())
    direct, grouped, sets, adds = [], [], [], []
    ordered: list[list] = []
    for group in root:
        kind, condition = _name(group), group.get("Condition") or ""
        if kind == "Import":
            one = ["import", condition, group.get("Project") or ""]
            direct.append(one)
            ordered.append(one)
        elif kind == "ImportGroup":
            many = [["import", together(condition, x.get("Condition")), x.get("Project") or ""] for x in group if _name(x) == "Import"]
            grouped += many
            ordered += many
        elif kind == "PropertyGroup":
            values = [["set", together(condition, x.get("Condition")), _name(x), (x.text or "").strip()] for x in group if len(x) == 0 and _name(x)]
            sets += values
            ordered += values
        elif kind == "ItemDefinitionGroup":
            for compiler in (x for x in group if _name(x) == "ClCompile"):
                found = {SETTINGS[_name(x)]: (x.text or "").strip() for x in compiler if _name(x) in SETTINGS and (x.text or "").strip()}
                if found:
                    adds.append(["add", together(condition, compiler.get("Condition")), found])
    return direct + grouped if project else ordered + adds


class _Asks(Exception):
    def __init__(self, path: str):
        self.path = path


def advance(state: dict, strict: bool) -> str | None:
    """Run a project's statements until one needs a file: its path, or null at the end. The answer is put in ``state["known"]``."""
    env, known, stack = state["variables"], state["known"], state["stack"]
    while stack:
        folder, lines, at = stack[-1]
        if at == len(lines):
            stack.pop()
            continue
        kind, condition, *said = lines[at]
        here = env | {"MSBuildThisFileDirectory": folder + "/"}

        def exists(path: str, folder: str = folder) -> bool:
            key = placed(path, folder).lower()
            if key not in known:
                raise _Asks(key)
            return known[key]

        try:
            skip = not holds(condition, here, exists) if condition and (kind != "add" or strict) else False
            if not skip and kind == "import":
                raw = said[0]
                target = "" if not raw or any(v in raw for v in TOOL_VARIABLES) else placed(expand(raw, here), folder)
                if target and target.lower() not in state["seen"]:
                    key = target.lower()
                    if state.get("answer") is None or state["answer"][0] != key:
                        return key
                    _, path, found = state.pop("answer")
                    if found is not None:
                        state["seen"].append(key)
                        state["imported"].append(path)
                        stack[-1][2] = at + 1
                        stack.append([posixpath.dirname(path), found, 0])
                        continue
        except _Asks as asked:
            return asked.path
        stack[-1][2] = at + 1
        if skip:
            continue
        if kind == "set":
            name, value = said
            value = _VARIABLE.sub(lambda m: here.get(m[1], "") if m[1] == name else here[m[1]] if m[1] == "MSBuildThisFileDirectory" else m[0], value)
            if name in FOLDER_PROPERTIES:
                value = placed(expand(value, here), folder).rstrip("/") + "/"
            env[name] = value
        elif kind == "add":
            for name, value in said[0].items():
                text = expand(value, here)
                if name == "options":
                    state["options"].append(text)
                    continue
                parts = [p.strip() for p in text.split(";")]
                parts = [p for p in parts if p and p not in INHERITED[name]]
                state[name] += [placed(p, folder) for p in parts] if name == "includes" else parts
    return None


def _known(files: DataFrame, listed: DataFrame | None) -> DataFrame:
    """``key, file, said``: every file at hand and every folder above one, by its path in lower case; of files with a text, what they say."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"].map(slashed), "said": pdf["text"].map(lambda t: json.dumps(statements(t, False)))})

    said = files.where("path is not null").select("path", "text").mapInPandas(parse, "path string, said string")
    paths = said.select("path") if listed is None else said.select("path").unionByName(listed.where("path is not null").select(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keys = paths.select(F.explode(above).alias("p")).where("p <> ''").select(F.lower("p").alias("key")).distinct()
    one = said.groupBy(F.lower("path").alias("key")).agg(F.min_by(F.struct("path", "said"), "path").alias("file"))
    return keys.join(one, "key", "left").select("key", F.col("file.path").alias("file"), F.col("file.said").alias("said"))


def sheet_settings(
    projects: DataFrame, files: DataFrame, config: str, listed: DataFrame | None = None, solution_dir: str | None = None,
    variables: dict[str, str] | None = None, strict: bool = False,
) -> DataFrame:
    """``(path, variables, includes, defines, options, imported)`` of ``projects(path, text)`` after all their sheets.

    ``files(path, text)`` are the sheets at hand, ``listed(path)`` other files that exist; paths compare without case.
    ``variables`` are known beforehand, like an environment.
    """
    configuration, _, platform = config.partition("|")
    given = dict(variables or {}) | {"Configuration": configuration, "Platform": platform, "PlatformShortName": PLATFORM_NAMES.get(platform, platform.lower())}
    if solution_dir:
        given["SolutionDir"] = slashed(solution_dir).rstrip("/") + "/"
    known = cut(_known(files, listed))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                folder = posixpath.dirname(slashed(path))
                env = given | {"MSBuildProjectDirectory": folder, "ProjectDir": folder + "/"}
                state = {"variables": env, "known": {}, "seen": [slashed(path).lower()], "imported": [], "includes": [], "defines": [], "options": [], "stack": [[folder, statements(text, True), 0]]}
                need = advance(state, strict)
                rows.append((path, json.dumps(state), need))
            yield pd.DataFrame(rows, columns=["path", "state", "need"])

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text, need, key, file, said in zip(pdf["path"], pdf["state"], pdf["need"], pdf["key"], pdf["file"], pdf["said"]):
                state = json.loads(text)
                there = isinstance(key, str)
                state["known"][need] = there
                state["answer"] = [need, file if isinstance(file, str) else None, json.loads(said) if isinstance(said, str) else None]
                need = advance(state, strict)
                rows.append((path, json.dumps(state), need))
            yield pd.DataFrame(rows, columns=["path", "state", "need"])

    states, done = cut(projects.where("path is not null").select("path", "text").mapInPandas(begin, STATE)), []
    while True:
        done.append(states.where("need is null"))
        asking = states.where("need is not null")
        if asking.isEmpty():
            break
        answered = asking.join(broadcast_if_small(known), F.col("need") == F.col("key"), "left")
        states = cut(answered.mapInPandas(go_on, STATE))

    def result(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["state"]):
                state = json.loads(text)
                env = {name: expand(value, state["variables"]) for name, value in state["variables"].items()}
                rows.append((path, json.dumps(env), state["includes"], state["defines"], " ".join(state["options"]), state["imported"]))
            yield pd.DataFrame(rows, columns=["path", "variables", "includes", "defines", "options", "imported"])

    found = reduce(DataFrame.unionByName, done).mapInPandas(result, "path string, variables string, includes array<string>, defines array<string>, options string, imported array<string>")
    return found.withColumn("variables", F.from_json("variables", "map<string,string>"))
