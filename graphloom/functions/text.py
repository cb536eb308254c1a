"""Text columns: node descriptions, names from paths, snippets, JSON in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directory names too generic to name a domain after.
WEAK_DIRECTORIES = [".", "internal", "pkg", "src", "cmd"]
DEFAULT_LINES = 50


def node_to_text(file: Column, name: Column, features: Column, node_id: Column) -> Column:
    """``file | name | f1, f2`` from the parts that are there, else the id."""
    empty = F.lit("")
    listed = F.array_join(features, ", ")
    parts = F.concat_ws(" | ", F.nullif(file, empty), F.nullif(name, empty), F.nullif(listed, empty))
    return F.coalesce(F.nullif(parts, empty), node_id)


def clean_components(path: Column) -> Column:
    """Components of a slash path without empty parts, ``.`` and resolvable ``..``."""
    raw = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    absolute = path.startswith("/")
    none = F.array().cast("array<string>")

    def fold(acc: Column, part: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        at_root = absolute & (F.size(acc) == 0)
        return (
            F.when((part == "..") & can_pop, popped)
            .when((part == "..") & at_root, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.aggregate(raw, none, fold)


def common_ancestor(paths: DataFrame, by: list[str], column: str = "path") -> DataFrame:
    """The deepest directory all paths of a group share, one row per group.

    The common prefix of the least and the greatest path, compared part by part, is the
    common prefix of all, so two aggregates do, and no group is ever gathered. ``.`` for
    relative paths with nothing in common, empty for a mix of absolute and relative.
    """
    parts = paths.where(F.col(column).isNotNull()).select(
        *by, clean_components(F.col(column)).alias("parts"), F.col(column).startswith("/").alias("rooted")
    )
    spans = parts.groupBy(*by).agg(
        F.min("parts").alias("lo"),
        F.max("parts").alias("hi"),
        F.bool_and("rooted").alias("all_rooted"),
        F.bool_or("rooted").alias("any_rooted"),
        F.bool_or(F.coalesce(F.get("parts", F.lit(0)), F.lit("")) == "..").alias("upward"),
    )
    shorter = F.least(F.size("lo"), F.size("hi"))
    places = F.sequence(F.lit(0), F.greatest(shorter, F.lit(1)) - 1)
    differ = F.filter(
        places, lambda i: ~F.get(F.col("lo"), i).eqNullSafe(F.get(F.col("hi"), i)) | (i >= shorter)
    )
    shared = F.when(F.size(differ) > 0, F.get(differ, F.lit(0))).otherwise(shorter)
    joined = F.array_join(F.slice("lo", F.lit(1), shared), "/")
    lca = (
        F.when(F.col("any_rooted") & ~F.col("all_rooted"), F.lit(""))
        .when(F.col("all_rooted"), F.concat(F.lit("/"), joined))
        .when((joined == "") & F.col("upward"), F.lit(""))
        .when(joined == "", F.lit("."))
        .otherwise(joined)
    )
    return spans.select(*by, lca.alias("lca"))


def name_words(name: Column) -> Column:
    """Words of a camel-case or snake-case name."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    plain = F.regexp_replace(spaced, "[^a-zA-Z0-9]+", " ")
    return F.filter(F.split(F.trim(plain), " +"), lambda w: w != "")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def dominant_terms(names: DataFrame, by: list[str], column: str = "name") -> DataFrame:
    """The most frequent word longer than two letters per group; ties go to the first."""
    words = names.select(*by, F.explode(name_words(F.col(column))).alias("word")).where("length(word) > 2")
    counts = words.groupBy(*by, F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("best"))
    return best.select(*by, _capital(F.col("best.word")).alias("term"))


def domain_names(lcas: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """Name per group: the last directory of a telling path, else the dominant term."""
    base = F.when(F.col("lca").isin("", ".", "/"), F.lit(".")).otherwise(
        F.element_at(F.split("lca", "/"), -1)
    )
    name = F.when(base.isin(WEAK_DIRECTORIES), F.coalesce("term", F.lit(""))).otherwise(_capital(base))
    return lcas.join(terms, by, "left").select(*by, "lca", name.alias("domain_name"))


def text_lines(files: DataFrame, by: list[str], column: str = "text") -> DataFrame:
    """One row per line, numbered from 1. A final newline starts no further line."""
    body = F.regexp_replace(F.col(column), "\\r?\\n\\z", "")
    return files.select(*by, F.posexplode(F.split(body, "\\r?\\n")).alias("pos", "content")).select(
        *by, (F.col("pos") + 1).cast("bigint").alias("line_number"), "content"
    )


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start..end`` (from 1, both included) joined; empty when the range is."""
    body = F.regexp_replace(text, "\\r?\\n\\z", "")
    lines = F.split(body, "\\r?\\n")
    first = F.greatest(start, F.lit(1))
    wanted = F.greatest(end - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, first.cast("int"), wanted.cast("int")), "\n")


def pattern_in_scope(content: Column, pattern: Column, context: int, first_line: Column) -> Column:
    """Matches of a literal in a text: an array of arrays of ``(number, content)``.

    Every line holding the literal makes one match, with ``context`` lines around it.
    """
    lines = F.split(content, "\n")
    last = F.size(lines) - 1
    numbered = F.transform(lines, lambda text, i: F.struct(i.alias("i"), text.alias("text")))
    hits = F.filter(numbered, lambda e: e["text"].contains(pattern))

    def around(hit: Column) -> Column:
        span = F.sequence(F.greatest(hit["i"] - context, F.lit(0)), F.least(hit["i"] + context, last))
        return F.transform(
            span,
            lambda j: F.struct((first_line + j).alias("number"), F.get(lines, j).alias("content")),
        )

    return F.transform(hits, around)


def json_in_text(text: Column) -> Column:
    """The JSON object or array inside free text; null when there is none.

    From the first opening brace or bracket to the last closer of the same kind.
    """
    start = F.regexp_instr(text, F.lit("[\\{\\[]"))
    opener = F.substr(text, start, F.lit(1))
    closer = F.when(opener == "{", F.lit("}")).otherwise(F.lit("]"))
    back = F.position(closer, F.reverse(text))
    stop = F.length(text) - back + 1
    body = F.substr(text, start, stop - start + 1)
    return F.when((start > 0) & (back > 0) & (stop > start), body)
