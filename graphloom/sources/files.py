"""Reading a source tree, with ignore files honoured.

Folders are listed and files are read by the tasks. ``pyarrow.fs`` is used as Spark's
listing hides names that start with an underscore, which source trees have.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache, reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import broadcast_if_small, cut

IGNORE_FILE, REPOSITORY_FOLDER = ".gitignore", ".git"


def _pattern(rule: str) -> str:
    """A regular expression for one ignore rule, over paths relative to the root."""
    folder_only = rule.endswith("/")
    rule = rule.rstrip("/")
    out, i = [], 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif rule.startswith("**", i):
            out.append(".*")
            i += 2
        elif rule[i] == "*":
            out.append("[^/]*")
            i += 1
        elif rule[i] == "?":
            out.append("[^/]")
            i += 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            # A class: a leading ! negates it, and it never matches a slash.
            inner = rule[i + 1 : end]
            negated = inner[0] in "!^"
            members = re.sub(r"[\\\[&^]", r"\\\g<0>", inner[negated:])
            out.append(f"(?!/)[{'^' * negated}{members}]")
            i = end + 1
        elif rule[i] == "\\" and i + 1 < len(rule):
            out.append(re.escape(rule[i + 1]))
            i += 2
        else:
            out.append(re.escape(rule[i]))
            i += 1
    # A rule without an inner slash matches at any depth.
    lead = "" if "/" in rule else "(?:.*/)?"
    return f"\\A{lead}{''.join(out)}" + ("/" if folder_only else "/?") + "\\z"


def read_rules(text: str, folder: str) -> list[tuple[bool, str]]:
    """``(ignore, pattern)`` of an ignore file in ``folder``, in order.

    A leading slash is dropped, and rules of a nested file are put below its folder.
    """
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        ignore = not line.startswith("!")
        line = line.lstrip("!") if not ignore else line
        line = line[1:] if line.startswith("/") else line
        if folder:
            line = f"{folder}/{line}"
        rules.append((ignore, _pattern(line)))
    return rules


Rule = tuple[bool, str]


def is_ignored(path: str, folder: bool, rules: list[tuple[bool, re.Pattern]]) -> bool:
    """Whether the last rule that matches a path ignores it; the folders above it are not."""
    shown = path + "/" if folder else path
    return next((ignore for ignore, pattern in reversed(rules) if pattern.search(shown)), False)


@lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("\\z", "\\Z"))


def opened(root: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return system, base.rstrip("/")


#: What listing a folder gives: its files, its folders with the ignore file that rules them, and the rules of its own ignore file with all above.
_LISTED = "kind string, path string, ruled string, rules array<struct<ignore:boolean,pattern:string>>"


def _list_folders(root: str):
    def run(batches):
        system, base = opened(root)
        local = isinstance(system, fs.LocalFileSystem)
        for pdf in batches:
            out = []
            for folder, ruled, given in zip(pdf["folder"], pdf["ruled"], pdf["rules"]):
                here = f"{base}/{folder}" if folder else base
                try:
                    entries = system.get_file_info(fs.FileSelector(here))
                except FileNotFoundError:
                    continue
                rules: list[Rule] = [(r["ignore"], r["pattern"]) for r in given] if given is not None else []
                if any(e.base_name == IGNORE_FILE and e.type == fs.FileType.File for e in entries):
                    with system.open_input_stream(f"{here}/{IGNORE_FILE}") as stream:
                        rules = rules + read_rules(stream.read().decode("utf-8", "replace"), folder)
                    ruled = folder
                    out.append(("rules", folder, None, [{"ignore": i, "pattern": p} for i, p in rules]))
                ready = [(i, _compiled(p)) for i, p in rules]
                for entry in entries:
                    name = entry.base_name
                    path = f"{folder}/{name}" if folder else name
                    # A link to a folder is not followed.
                    deeper = entry.type == fs.FileType.Directory and not (local and os.path.islink(entry.path))
                    if (deeper and name == REPOSITORY_FOLDER) or (not deeper and entry.type != fs.FileType.File) or is_ignored(path, deeper, ready):
                        continue
                    out.append(("folder" if deeper else "file", path, ruled, None))
            yield pd.DataFrame(out, columns=["kind", "path", "ruled", "rules"])

    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path)`` relative to ``root``, without the repository folder and ignored files.

    Folders of one depth are listed together, each by a task that reads its ignore file and passes its rules on to the
    folders below; rules are kept once for each ignore file. An ignored folder is not entered. There are as many rounds as the tree is deep.
    """
    rules = spark.createDataFrame([], "ruled string, rules array<struct<ignore:boolean,pattern:string>>")
    level = spark.createDataFrame([("", None)], "folder string, ruled string")
    files = []
    while True:
        # Rows are few bytes and much work: they are dealt out evenly, whatever their size.
        dealt = level.join(broadcast_if_small(rules), "ruled", "left").select("folder", "ruled", "rules").repartition(2 * spark.sparkContext.defaultParallelism)
        found = cut(dealt.mapInPandas(_list_folders(root), _LISTED))
        files.append(found.where("kind = 'file'").select("path"))
        level = found.where("kind = 'folder'").select(F.col("path").alias("folder"), "ruled")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, files)
        rules = rules.unionByName(found.where("kind = 'rules'").select(F.col("path").alias("ruled"), "rules"))


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """``(path, text)`` of listed files; a file that is gone is left out."""

    def run(batches):
        system, base = opened(root)
        for pdf in batches:
            kept, texts = [], []
            for path in pdf["path"]:
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        texts.append(stream.read().decode("utf-8", "replace"))
                        kept.append(path)
                except FileNotFoundError:
                    continue
            yield pd.DataFrame({"path": pd.Series(kept, dtype=object), "text": pd.Series(texts, dtype=object)})

    return paths.select("path").mapInPandas(run, "path string, text string")
