"""Nodes and edges of source files, per language.

Definitions, calls and references are found by pattern on lines, enclosing scopes by the
windows of :mod:`graphloom.sources.scopes`, and names are resolved by joins with the
imports, usings and fields of the same file.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import clean_components
from graphloom.model import PropertyGraph, conform_nodes
from graphloom.session import cut_in_place, shares, sorted_join
from graphloom.sources.lexer import without_comments
from graphloom.sources.scopes import enclosing, innermost, names_of, numbered_lines, with_ends, with_levels

# File suffix to language.
SUFFIXES = {
    ".py": "python", ".vb": "vb", ".sql": "sql", ".cs": "cs", ".java": "java", ".ts": "ts",
    ".asp": "asp", ".aspx": "asp", ".ascx": "asp",
}
# Files that one task reads.
FILES = 5_000
# Words that look like calls but are statements.
VB_STATEMENTS = ["if", "while", "for", "catch"]
STATEMENTS = [
    "if", "for", "foreach", "while", "switch", "catch", "return", "new", "using", "lock", "super", "base", "this",
    "function", "typeof", "sizeof", "nameof", "throw", "synchronized", "await", "else", "constructor",
]
PYTHON_STATEMENTS = ["if", "elif", "while", "for", "return", "and", "or", "not", "in", "lambda", "yield", "assert", "class", "def", "with", "except"]
# Types that need no import.
JAVA_PLAIN_TYPES = ["String", "Integer", "Boolean", "Object", "System", "Exception", "List", "Map", "Set"]

# Words that may stand before a definition of the dialect, and those that open one.
VB_MODIFIERS = ["Public", "Private", "Friend", "Protected", "Partial", "Overrides", "Shared", "Overridable", "MustInherit", "NotInheritable", "Async"]
VB_BLOCKS = ["Class", "Module", "Structure", "Interface"]
VB_ROUTINES = ["Sub", "Function"]
_VB_MODS = f"(?:(?:{'|'.join(VB_MODIFIERS)})\\s+)*"

_MODS = "(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|override|virtual|async|readonly|export|default|declare|synchronized|unsafe|new|extern|get|set|\\*)\\s+)*"
_TYPE = "[\\w.]+(?:<[^()]*>)?(?:\\[\\])*\\??"


@dataclass(frozen=True)
class Rules:
    """Patterns of one language; group 1 is the name, group 2 the parameters."""

    style: str
    klass: str
    functions: tuple[str, ...]
    namespace: str | None = None
    constructor: str | None = None
    statements: tuple[str, ...] = ()
    end: str | None = None
    field: str | None = None
    call: str = "(?:([\\w.]+)\\.)?(\\w+)\\s*(?:<[\\w, ]+>)?\\("


RULES = {
    "vb": Rules(
        "keyword",
        rf"(?i)^\s*{_VB_MODS}(?:{'|'.join(VB_BLOCKS)})\s+(\w+)()",
        (rf"(?i)^\s*{_VB_MODS}(?:{'|'.join(VB_ROUTINES)})\s+(\w+)()",),
        namespace=r"(?i)^\s*Namespace\s+([\w.]+)()",
        end=rf"(?i)^\s*End\s+(?:{'|'.join(['Namespace', *VB_BLOCKS, *VB_ROUTINES])})\b",
        statements=tuple(VB_STATEMENTS), call=r"()(\w+)\(",
    ),
    "cs": Rules(
        "brace",
        rf"^\s*(?:\[.*\]\s*)*{_MODS}(?:class|interface|struct|record)\s+(\w+)()",
        (rf"^\s*(?:\[.*\]\s*)*{_MODS}{_TYPE}\s+(\w+)\s*(?:<[\w, ]+>)?\(([^)]*)\)\s*(?:\{{.*|=>.*|;|where.*)?$",),
        namespace=r"^\s*namespace\s+([\w.]+)()",
        constructor=rf"^\s*{_MODS}(\w+)\s*\(([^)]*)\)\s*(?::.*|\{{.*)?$",
        statements=tuple(STATEMENTS),
        field=rf"^\s*{_MODS}({_TYPE})\s+(\w+)\s*(?:;|=|\{{\s*get)",
    ),
    "java": Rules(
        "brace",
        rf"^\s*(?:@\w+\s*)*{_MODS}(?:class|interface|enum)\s+(\w+)()",
        (rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]+>\s*)?{_TYPE}\s+(\w+)\s*\(([^)]*)\)\s*(?:throws [\w., ]+)?\s*(?:\{{.*|;)?$",),
        constructor=rf"^\s*{_MODS}(\w+)\s*\(([^)]*)\)\s*(?:throws [\w., ]+)?\s*\{{.*$",
        statements=tuple(STATEMENTS),
        field=rf"^\s*(?:@\w+\s+)*{_MODS}({_TYPE})\s+(\w+)\s*(?:;|=)",
    ),
    "ts": Rules(
        "brace",
        rf"^\s*{_MODS}(?:class|interface)\s+(\w+)()",
        (
            rf"^\s*{_MODS}function\s*\*?\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)",
            rf"^\s*{_MODS}(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\s*)?\(([^)]*)\)\s*(?::[^=]+)?(?:=>|\{{)",
            rf"^\s*{_MODS}(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)\s*(?::\s*[^{{;]+)?\s*\{{",
        ),
        statements=tuple(s for s in STATEMENTS if s != "constructor"),
        field=r"^\s*(?:(?:public|private|protected|readonly|static)\s+)*(\w+)[?!]?\s*:\s*([^=;({]+)(?:;|=)",
    ),
    "python": Rules(
        "indent", r"^\s*class\s+(\w+)()", (r"^\s*(?:async\s+)?def\s+(\w+)\s*()",), statements=tuple(PYTHON_STATEMENTS),
        call=r"(?:([\w.]+)\.)?(\w+)\(",
    ),
    "sql": Rules(
        "sql", r"(?!)()()", (r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+([\w.]+)()",), call=r"()([\w.]+)\(",
    ),
}


def detect_language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "(\\.[A-Za-z]+)\\z", 1))
    lang = F.lit(None).cast("string")
    for ending, name in SUFFIXES.items():
        lang = F.when(suffix == ending, name).otherwise(lang)
    return lang


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike("(_test\\.go|test\\.java|tests?\\.cs|\\.test\\.ts|\\.spec\\.ts)\\z") | low.contains("/tests/")


# ---- server pages ----------------------------------------------------------------------

# A code block, and a script element that runs on the server, wherever that attribute stands in its tag.
_BLOCK = "<%(?:[^%]|%(?!>))*+%>"
_TAG = "<script\\b(?=[^>]*\\brunat\\s*=\\s*[\"']?server\\b)[^>]*>"
_SCRIPT = f"(?si){_TAG}.*?</script>"
_OPENING = f"(?i)^{_TAG}"


def _mask(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\r\\n]", " ")


def _keep(text: Column, pattern: str, inside, outside) -> Column:
    """Text with matches of ``pattern`` and the stretches between them mapped apart."""
    blocks = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    shown = F.concat(F.transform(blocks, inside), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.transform(between, outside), shown, lambda a, b: F.concat(a, b)), "")


def mask_page(text: Column) -> Column:
    """Server page text with everything but code blanked, line for line."""

    def block(b: Column) -> Column:
        skip = F.when(b.startswith("<%="), 3).otherwise(2)
        code = F.substring(b, skip + 1, F.length(b) - skip - 2)
        return F.when(b.startswith("<%@"), _mask(b)).otherwise(
            F.concat(F.repeat(F.lit(" "), skip), code, F.lit("  "))
        )

    def script(s: Column) -> Column:
        tag = F.length(F.regexp_extract(s, _OPENING, 0))
        return F.concat(_mask(F.left(s, tag)), F.substring(s, tag + 1, F.length(s) - tag - 9), F.lit(" " * 9))

    return _keep(text, _BLOCK, block, lambda out: _keep(out, _SCRIPT, script, _mask))


def page_language(path: Column, text: Column) -> Column:
    named = F.lower(F.regexp_extract(text, "(?i)<%@[^%]*?\\blanguage\\s*=\\s*[\"']([^\"']+)[\"']", 1))
    newer = F.lower(path).rlike("\\.as[pc]x\\z")
    return (
        F.when(named.isin("c#", "cs", "csharp"), "cs")
        .when(named.isin("vb", "vbscript", "vbs", "vb.net"), "vb")
        .when(newer, "cs")
        .otherwise("vb")
    )


def supported(files: DataFrame) -> DataFrame:
    """``(path, lang, text)`` of files in a known language, with slashes in their paths."""
    named = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "text")
    return named.select("path", detect_language(F.col("path")).alias("lang"), "text").where("lang is not null")


def prepare(known: DataFrame) -> DataFrame:
    """``(path, lang, text, shift)`` of supported files; pages become their code.

    Visual Basic in a page is wrapped in a module, which moves its lines by one.
    """
    page = F.col("lang") == "asp"
    lang = F.when(page, page_language(F.col("path"), F.col("text"))).otherwise(F.col("lang"))
    masked = F.when(page, mask_page(F.col("text"))).otherwise(F.col("text"))
    rows = known.select("path", lang.alias("lang"), masked.alias("text"), page.alias("page"))
    wrap = F.col("page") & (F.col("lang") == "vb")
    return rows.select(
        "path", "lang",
        F.when(wrap, F.concat(F.lit("Module AspWrapper\n"), "text", F.lit("\nEnd Module"))).otherwise(F.col("text")).alias("text"),
        wrap.cast("int").alias("shift"),
    )


# ---- definitions -----------------------------------------------------------------------


def _parameter_types(params: Column, lang: str) -> Column:
    """Parameter types in declaration order."""
    each = F.filter(F.transform(F.split(params, ",(?![^<]*>)"), lambda p: F.trim(p)), lambda p: p != "")
    bare = F.transform(each, lambda p: F.regexp_replace(F.regexp_replace(p, "\\s*=.*", ""), "^(?:(?:ref|out|in|this|params|final|@\\w+)\\s+)+", ""))
    if lang == "ts":
        return F.transform(F.filter(bare, lambda p: p.contains(":")), lambda p: F.trim(F.regexp_replace(p, "^[^:]*:", "")))
    typed = F.transform(bare, lambda p: F.regexp_replace(p, "\\s+\\w+\\z", ""))
    return F.transform(typed, lambda p: F.regexp_replace(p, "\\s", "")) if lang == "java" else typed


def _signature(params: Column, lang: str) -> Column:
    """Parameter types in brackets; empty where a language has no signature."""
    if lang not in ("cs", "java"):
        return F.lit("")
    return F.concat(F.lit("("), F.array_join(_parameter_types(params, lang), "," if lang == "java" else ", "), F.lit(")"))


def _with_last(lines: DataFrame) -> DataFrame:
    """Adds ``last``: of a line whose bracket stays open, the line where it closes and a block or statement ends it.

    Where that is comes from one running window over the file read backwards.
    """
    code = F.col("code")
    back = W.partitionBy("path").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    next_of = lambda mark: F.last(F.when(code.contains(mark) if len(mark) == 1 else code.rlike(mark), F.col("n")), ignorenulls=True).over(back)
    marked = lines.withColumn("closes", F.when(code.contains(")"), F.col("n")).otherwise(next_of(")"))).withColumn("ends", next_of("[{;]"))
    last = F.when(_stays_open(code) & F.col("closes").isNotNull(), F.greatest("closes", F.coalesce("ends", "closes")))
    return marked.withColumn("last", last).drop("closes", "ends")


def _stays_open(code: Column) -> Column:
    return F.size(F.split(code, "\\(")) > F.size(F.split(code, "\\)"))


def _with_heads(marked: DataFrame) -> DataFrame:
    """Adds ``head``: the code of a line whose bracket stays open, read on to ``last``; only such lines are joined with those they go on to."""
    code = F.col("code")
    longer = marked.where(F.col("last") > F.col("n")).select("path", F.col("n").alias("at"), F.explode(F.sequence("n", "last")).alias("n"))
    parts = sorted_join(longer, marked.select("path", "n", "code"), ["path", "n"]).groupBy("path", F.col("at").alias("n"))
    heads = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]), " ").alias("whole"))
    opens = _stays_open(code)
    whole = F.coalesce(F.regexp_extract("whole", "^[^)]*\\)[^{;]*[{;]?", 0), F.when(opens, F.regexp_extract(code, "^[^)]*\\)[^{;]*[{;]?", 0)), code)
    return sorted_join(marked, heads, ["path", "n"], "left").withColumn("head", F.when(opens & F.col("last").isNotNull(), whole).otherwise(code)).drop("whole", "last")


def _definitions(lines: DataFrame, rules: Rules, lang: str) -> DataFrame:
    """``(path, n, level, kind, name, signature, closed, line)`` of what lines define."""
    if rules.style == "brace":
        lines = _with_heads(lines)
        code = F.col("head")
    else:
        code = F.col("code")
    own = F.col("code")
    offers: list[Column] = []

    def offer(pattern: str, what: str, skip_statements: bool) -> None:
        found = F.regexp_extract(code, pattern, 1)
        hit = code.rlike(pattern) & (found != "")
        if skip_statements:
            hit = hit & ~F.lower(found).isin(*rules.statements) & ~code.rlike("^\\s*(?:return|new|throw|await|else)\\b")
        offers.append(F.when(hit, F.struct(F.lit(what).alias("kind"), found.alias("name"), F.regexp_extract(code, pattern, 2).alias("params"))))

    if rules.namespace:
        offer(rules.namespace, "namespace", False)
    offer(rules.klass, "class", False)
    if rules.constructor:
        # First, as a method pattern would take a modifier for its type.
        offer(rules.constructor, "constructor", True)
    for pattern in rules.functions:
        offer(pattern, "function", bool(rules.statements) and lang != "vb")
    # As a list of one or none: the patterns are matched once, where a filter would match them again.
    offered = F.explode(F.array_compact(F.array(F.coalesce(*offers)))).alias("d")
    found = lines.select("path", "n", "level", "after", "line", "code", offered).select("*", "d.*")
    closed = F.lit(False)
    if rules.style == "brace":
        one_line = own.contains("{") & (F.col("after") <= F.col("level"))
        closed = one_line | (~own.contains("{") & own.rlike(";\\s*$"))
    return found.select(
        "path", "n", "level", "kind", "name", _signature(F.col("params"), lang).alias("signature"), closed.alias("closed"), "line",
        _parameter_types(F.col("params"), lang).alias("takes"),
    )


def _levelled(lines: DataFrame, rules: Rules) -> tuple[DataFrame, str]:
    if rules.style == "keyword":
        code = F.col("line")
        ends = code.rlike(rules.end)
        starts = ~ends & (code.rlike(rules.namespace) | code.rlike(rules.klass) | code.rlike(rules.functions[0]))
        return with_levels(lines, "keyword", starts, ends), "keyword"
    if rules.style == "sql":
        # A function opens at its header and ends at the first line that ends a statement
        # outside a quoted body.
        so_far = W.partitionBy("path").orderBy("n")
        quoted = (F.sum((F.size(F.split("line", "\\$\\$")) - 1)).over(so_far)) % 2
        opened = F.col("line").rlike(rules.functions[0])
        marked = lines.withColumn("stop", (quoted == 0) & F.col("line").rlike(";\\s*$"))
        header = marked.withColumn("hs", F.last(F.when(opened, F.col("n")), True).over(so_far))
        first = header.withColumn("stops", F.sum(F.col("stop").cast("int")).over(W.partitionBy("path", "hs").orderBy("n")))
        ends = F.col("hs").isNotNull() & F.col("stop") & (F.col("stops") == 1)
        return with_levels(first, "keyword", opened, ends).drop("stop", "stops", "hs"), "keyword"
    return with_levels(_with_last(lines) if rules.style == "brace" else lines, rules.style), rules.style


def _dotted(*parts: Column) -> Column:
    """Names joined by dots, empty and null parts left out."""
    kept = F.filter(F.flatten(F.array(*[p if isinstance(p, Column) else F.array(p) for p in parts])), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, ".")


def _one(value: Column) -> Column:
    return F.array(value)


def _qualified(lang: str, around: Column, name: Column) -> Column:
    """Qualified name of something called ``name`` inside ``around``."""
    classes, spaces = names_of(around, "class"), names_of(around, "namespace")
    last_class = F.coalesce(innermost(around, "class")["name"], F.lit(""))
    if lang == "vb":
        return _dotted(spaces, classes, _one(name))
    if lang == "cs":
        space = F.coalesce(innermost(around, "namespace")["name"], F.col("file_space"), F.lit(""))
        return _dotted(_one(space), classes, _one(name))
    if lang == "java":
        return _dotted(_one(F.coalesce(F.col("file_space"), F.lit(""))), _one(last_class), _one(name))
    return F.concat(F.col("path"), F.lit(":"), _dotted(_one(last_class), _one(name)))


def _node_id(lang: str, label: Column, fqn: Column, signature: Column) -> Column:
    return fqn if lang == "vb" else F.concat_ws(":", label, fqn, signature)


def _file_spaces(lines: DataFrame, texts: DataFrame, lang: str) -> DataFrame:
    """The package, or the namespace declared for a whole file, by path."""
    pattern = {"java": "^\\s*package\\s+([\\w.]+)\\s*;", "cs": "^\\s*namespace\\s+([\\w.]+)\\s*;"}.get(lang)
    if pattern is None:
        return texts.select("path").distinct().withColumn("file_space", F.lit(None).cast("string"))
    hit = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    return lines.groupBy("path").agg(F.max(hit).alias("file_space"))


def _found(text: Column, pattern: str, *groups: int) -> Column:
    """All matches of a pattern in a text, one struct of the groups each."""
    return F.explode(F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups))).alias("m")


def _named(rows: DataFrame, names: Column) -> DataFrame:
    """``rows`` with ``name`` and ``alias`` for each of the listed ``name [as alias]``."""
    each = rows.withColumn("spec", F.explode(F.split(F.regexp_replace(names, "\\s+", " "), ","))).withColumn("spec", F.split(F.trim(F.regexp_replace("spec", "^ *type ", "")), " as "))
    return each.withColumn("name", F.trim(F.element_at("spec", 1))).withColumn("alias", F.trim(F.element_at("spec", -1))).where("name <> ''").drop("spec")


def _imports(lines: DataFrame, texts: DataFrame, lang: str) -> DataFrame:
    """``(path, alias, target)`` of imported names; lists over several lines are read from the text as a whole."""
    line = F.col("line")
    if lang == "java":
        name = F.regexp_extract(line, "^\\s*import\\s+(?:static\\s+)?([\\w.]+)\\s*;", 1)
        return lines.select("path", name.alias("target")).where("target <> ''").select("path", F.element_at(F.split("target", "\\."), -1).alias("alias"), "target")
    if lang == "python":
        joined = F.regexp_replace("code", "\\\\\\r?\\n", " ")
        plain = _named(texts.select("path", _found(joined, "(?m)^[ \\t]*import[ \\t]+([\\w., \\t]+)", 1)), F.col("m.g1")).select("path", "alias", F.col("name").alias("target"))
        listed = texts.select("path", _found(joined, "(?m)^[ \\t]*from[ \\t]+([\\w.]+)[ \\t]+import[ \\t]*(?:\\(([^)]*)\\)|([\\w, \\t]+))", 1, 2, 3))
        froms = _named(listed.select("path", F.col("m.g1").alias("module"), F.concat("m.g2", "m.g3").alias("names")), F.col("names"))
        return plain.unionByName(froms.select("path", "alias", F.concat("module", F.lit("."), "name").alias("target")))
    if lang == "ts":
        pattern = "(?m)^[ \\t]*import\\s+(?:type\\s+)?(?:([\\w$]+)\\s*,?\\s*)?(?:\\{([^}]*)\\}|\\*\\s*as\\s+([\\w$]+))?\\s*from\\s*[\"']([^\"']+)[\"']"
        found = texts.select("path", _found(F.col("text"), pattern, 1, 2, 3, 4))
        folder = F.regexp_replace("path", "[^/]*\\z", "")
        joined = F.array_join(clean_components(F.concat(folder, "module")), "/")
        full = F.when(joined.rlike("\\.[A-Za-z]+\\z"), joined).otherwise(F.concat(joined, F.lit(".ts")))
        rows = found.select("path", F.col("m.g4").alias("module"), F.concat_ws(",", "m.g2", F.when(F.col("m.g1") != "", F.col("m.g1")), F.when(F.col("m.g3") != "", F.col("m.g3"))).alias("names"))
        rows = rows.withColumn("file", F.when(F.col("module").startswith("."), full).otherwise(F.col("module")))
        return _named(rows, F.col("names")).select("path", "alias", F.concat("file", F.lit(":"), "name").alias("target"))
    return lines.sparkSession.createDataFrame([], "path string, alias string, target string")


def _resolved(rows: DataFrame, imports: DataFrame, column: str, out: str, fallback: Column) -> DataFrame:
    """``out`` is the import target of ``column`` where there is one, else ``fallback``."""
    found = imports.groupBy("path", "alias").agg(F.max("target").alias("__target")).withColumnRenamed("alias", column)
    return sorted_join(rows, found, ["path", column], "left").withColumn(out, F.coalesce("__target", fallback)).drop("__target")


def _java_type(name: Column) -> Column:
    plain = name.contains(".") | name.isin(JAVA_PLAIN_TYPES) | F.col("file_space").isNull()
    return F.when(plain, name).otherwise(F.concat("file_space", F.lit("."), name))


def _extract(files: DataFrame, lang: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of the files of one language.

    Texts are dealt out by path into as many parts as the files. All that is read out of them stays where its file is: windows, groups
    and joins by path, or by path and more, find their rows in place and shuffle nothing.
    """
    rules = RULES[lang]
    texts = cut_in_place(without_comments(files.where(F.col("lang") == lang), lang).repartition(parts, "path"))
    raw = numbered_lines(texts)
    lines, style = _levelled(raw, rules)
    lines = cut_in_place(lines)
    spaces = cut_in_place(_file_spaces(lines, texts, lang))
    usings = cut_in_place(_usings(lines)) if lang == "cs" else None
    imports = cut_in_place(_imports(lines, texts, lang))
    defs = with_ends(_definitions(lines, rules, lang), lines, style)
    if lang == "cs":
        # A namespace that ends with its own line covers the file; it is no block.
        defs = defs.where("not (kind = 'namespace' and closed)")
    defs = cut_in_place(defs)
    keyed = defs.withColumn("item", F.concat_ws("#", "path", "n"))
    placed = sorted_join(enclosing(keyed, defs), spaces, "path", "left").select(
        "path", "n", "level", "end_line", "kind", "name", "signature", "line", "takes", "around", "file_space"
    )
    around, name = F.col("around"), F.col("name")
    in_class = innermost(around, "class").isNotNull()
    if lang in ("cs", "java"):
        # A constructor carries the name of its class; a method has to be inside one.
        placed = placed.where((F.col("kind") != "constructor") | (innermost(around, "class")["name"] == name))
        if lang == "java":
            placed = placed.where(F.col("kind").isin("class") | in_class)
    label = F.when(F.col("kind") == "class", "Class").otherwise("Function")
    if lang == "java":
        label = F.when(F.col("kind") == "constructor", "Constructor").when(
            (F.col("kind") == "class") & F.col("line").rlike("\\binterface\\s"), "Interface"
        ).when((F.col("kind") == "class") & F.col("line").rlike("\\benum\\s"), "Enum").otherwise(label)
    fqn = _qualified(lang, around, name)
    if lang in ("java", "python"):
        fqn = F.when(F.col("kind") == "class", _qualified(lang, F.array().cast("array<struct<level:int,n:bigint,end_line:bigint,kind:string,name:string,signature:string>>"), name)).otherwise(fqn)
    signature = F.when(F.col("kind") == "class", F.lit("")).otherwise(F.col("signature"))
    nodes = placed.where("kind <> 'namespace'").withColumn("label", label).withColumn("fqn", fqn).withColumn(
        "id", _node_id(lang, F.col("label"), F.col("fqn"), signature)
    )
    nodes = cut_in_place(nodes)
    owner = nodes.where("kind <> 'class'").select("path", F.col("n").alias("def_line"), F.col("id").alias("src"))
    klass = nodes.where("kind = 'class'").select("path", F.col("n").alias("class_line"), F.col("id").alias("class_id"), F.col("fqn").alias("class_fqn"))
    edges: list[DataFrame] = []

    members = sorted_join(nodes.where("kind <> 'class'").withColumn("class_line", innermost(around, "class")["n"]), klass, ["path", "class_line"])
    if lang in ("vb", "java"):
        edges.append(members.select(F.col("class_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_METHOD").alias("type")))
    edges.extend(_inheritance(nodes, imports if usings is None else usings, lang))
    if rules.field:
        edges.append(_injected(members, usings, imports, lang))
    field_rows = None
    if rules.field:
        field_rows, field_nodes, more = _fields(lines, defs, klass, spaces, usings, imports, rules, lang)
        nodes = nodes.unionByName(field_nodes, allowMissingColumns=True)
        edges.extend(more)
    edges.append(_calls(lines, defs, owner, spaces, usings, imports, field_rows, klass, rules, lang))
    if lang in ("cs", "java"):
        mark = "(?i)^\\s*\\[(?:Fact|Theory|Test)\\b" if lang == "cs" else "^\\s*@Test\\b"
        tagged = lines.where(F.col("line").rlike(mark)).select("path", (F.col("n") + 1).alias("n"))
        nodes = sorted_join(nodes, tagged.distinct().withColumn("tagged", F.lit(True)), ["path", "n"], "left")
    else:
        nodes = nodes.withColumn("tagged", F.lit(None).cast("boolean"))
    if lang == "ts":
        test = "^\\s*(?:describe|it|test)\\s*\\(\\s*[\"'`]([^\"'`]+)"
        title = F.regexp_extract("line", test, 1)
        titled = lines.where(F.col("line").rlike(test)).select("path", "n", title.alias("name"), F.lit(True).alias("tagged")).withColumn(
            "fqn", F.concat("path", F.lit(":"), "name")
        )
        nodes = nodes.unionByName(
            titled.withColumn("label", F.lit("Function")).withColumn("id", F.concat(F.lit("Function:"), "fqn", F.lit(":"))), allowMissingColumns=True
        )
    test_mark = F.when(F.col("label").isin("Function", "Method") & F.coalesce("tagged", F.lit(False)), F.lit(True))
    rows = nodes.select("id", "label", "name", "fqn", F.col("path").alias("file"), F.col("n").alias("start_line"), "end_line",
                        test_mark.alias("is_test"), F.col("signature").alias("sig"))
    return rows, reduce(DataFrame.unionByName, edges)


def _inheritance(nodes: DataFrame, imports: DataFrame, lang: str) -> list[DataFrame]:
    classes = nodes.where("kind = 'class'")
    line = F.col("line")

    def listed(text: Column) -> Column:
        names = F.transform(F.split(text, ",(?![^<]*>)"), lambda s: F.trim(F.regexp_replace(s, "<.*", "")))
        return F.filter(names, lambda s: s != "")

    if lang == "python":
        bases = classes.select("id", "path", F.explode(listed(F.regexp_extract(line, "class\\s+\\w+\\s*\\(([^)]*)\\)", 1))).alias("base"))
        return [bases.select(F.col("id").alias("src"), F.concat(F.lit("Class:"), "path", F.lit(":"), "base", F.lit(":")).alias("dst"), F.lit("EXTENDS").alias("type"))]
    if lang == "cs":
        bases = classes.select("id", "path", "file_space", "around", F.explode(listed(F.regexp_extract(line, "(?:class|interface|struct|record)\\s+\\w+(?:<[^>]*>)?\\s*:\\s*([^{]+)", 1))).alias("base"))
        return [_candidates(bases.withColumn("src", F.col("id")), imports, "base", "INHERITS")]
    out = []
    if lang in ("java", "ts"):
        for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
            text = F.regexp_extract(line, f"\\b{word}\\s+([\\w.<>, ]+?)(?:\\s+implements\\b|\\s*\\{{|\\s*$)", 1)
            bases = classes.select("id", "path", "file_space", F.explode(listed(text)).alias("base"))
            fallback = _java_type(F.col("base")) if lang == "java" else F.concat("path", F.lit(":"), "base")
            out.append(_resolved(bases, imports, "base", "dst", fallback).select(F.col("id").alias("src"), "dst", F.lit(edge).alias("type")))
    return out


def _injected(members: DataFrame, usings: DataFrame | None, imports: DataFrame, lang: str) -> DataFrame:
    """DEPENDS_ON edges of a class to the parameter types of its constructors."""
    made = F.col("name") == "constructor" if lang == "ts" else F.col("kind") == "constructor"
    split = F.split(F.col("tname"), "[<>,\\s|&]+")
    whole = members.where(made).select("path", "around", "file_space", F.col("class_id").alias("src"), F.explode("takes").alias("tname"))
    if lang == "cs":
        return _candidates(whole.withColumn("tname", F.regexp_replace("tname", "<.*|\\?|\\[\\]", "")), usings, "tname", "DEPENDS_ON")
    each = whole.withColumn("tname", F.explode(F.filter(split, lambda t: (t != "") & ~t.isin("Array", "Promise"))))
    fallback = _java_type(F.col("tname")) if lang == "java" else F.concat("path", F.lit(":"), "tname")
    return _resolved(each, imports, "tname", "dst", fallback).select("src", "dst", F.lit("DEPENDS_ON").alias("type"))


def _usings(lines: DataFrame) -> DataFrame:
    pattern = "^\\s*using\\s+([\\w.]+)\\s*;"
    return lines.where(F.col("line").rlike(pattern)).select("path", F.regexp_extract("line", pattern, 1).alias("space")).distinct()


def _candidates(rows: DataFrame, usings: DataFrame, column: str, edge: str, suffix: Column | None = None) -> DataFrame:
    """Edges to every namespace a plain name may come from: its own and the used ones."""
    name = F.col(column)
    own = F.coalesce(innermost(F.col("around"), "namespace")["name"], F.col("file_space"), F.lit(""))
    tail = F.lit("") if suffix is None else suffix
    local = F.when(name.contains(".") | (own == ""), name).otherwise(F.concat(own, F.lit("."), name))
    here = rows.select("src", F.concat(local, tail).alias("dst"))
    spaces = usings.select("path", F.col("target").alias("space")) if "target" in usings.columns else usings
    used = sorted_join(rows.where(~name.contains(".")), spaces, "path").select("src", F.concat("space", F.lit("."), name, tail).alias("dst"))
    return here.unionByName(used).withColumn("type", F.lit(edge))


def _fields(lines, defs, klass, spaces, usings, imports, rules, lang):
    """Fields of classes: their types by name, their nodes, and the edges they add."""
    code = F.col("code")
    type_group, name_group = (2, 1) if lang == "ts" else (1, 2)
    found = lines.where(code.rlike(rules.field) & ~code.rlike("^\\s*(?:return|using|import|package|namespace|throw|else|await|const|let|var|export)\\b"))
    found = found.select("path", "n", "level", F.concat_ws("#", "path", "n").alias("item"),
                         F.trim(F.regexp_extract(code, rules.field, name_group)).alias("name"), F.trim(F.regexp_extract(code, rules.field, type_group)).alias("declared"))
    around = F.col("around")
    # Directly in a class: the closest definition about it is one.
    inside = enclosing(found, defs).where(F.element_at(around, -1)["kind"] == "class").withColumn("class_line", innermost(around, "class")["n"])
    inside = sorted_join(sorted_join(inside, klass, ["path", "class_line"]), spaces, "path", "left")
    base = F.trim(F.regexp_replace("declared", "<.*|\\[\\]|\\?", ""))
    rows = cut_in_place(inside.withColumn("base", base))
    label = F.lit("Field")
    node_fqn = F.concat("class_fqn", F.lit("."), "name")
    nodes = rows.select("path", "n", "name", label.alias("label"), node_fqn.alias("fqn"), F.concat_ws(":", label, node_fqn, F.lit("")).alias("id"), F.col("n").alias("end_line"))
    types = F.filter(F.split("declared", "[<>,\\s|&]+"), lambda s: (s != "") & ~s.isin("Array", "Promise"))
    each = rows.select("path", "around", "file_space", F.col("class_id").alias("src"), F.explode(types).alias("tname"))
    edges = []
    if lang == "cs":
        edges.append(_candidates(rows.select("path", "around", "file_space", F.col("class_id").alias("src"), F.col("base").alias("tname")), usings, "tname", "DEPENDS_ON"))
        known = rows.select("path", "class_line", F.col("name").alias("field"), F.col("base").alias("ftype"))
        return known, nodes, edges
    fallback = _java_type(F.col("tname")) if lang == "java" else F.concat("path", F.lit(":"), "tname")
    edges.append(_resolved(each, imports, "tname", "dst", fallback).select("src", "dst", F.lit("DEPENDS_ON").alias("type")))
    edges.append(rows.select(F.col("class_id").alias("src"), F.concat_ws(":", label, node_fqn, F.lit("")).alias("dst"), F.lit("DEFINES").alias("type")))
    first = rows.select("path", "class_line", "file_space", F.col("name").alias("field"), F.col("base").alias("fbase"))
    fallback = _java_type(F.col("fbase")) if lang == "java" else F.concat("path", F.lit(":"), "fbase")
    known = _resolved(first, imports, "fbase", "ftype", fallback).select("path", "class_line", "field", "ftype")
    return known, nodes, edges


def _calls(lines, defs, owner, spaces, usings, imports, fields, klass, rules, lang) -> DataFrame:
    """CALLS edges from the enclosing function of every call on a line."""
    code = F.col("code")
    def_lines = defs.where("kind <> 'namespace'").select("path", "n", F.lit(True).alias("is_def"))
    body = F.when(F.col("is_def"), F.regexp_extract(code, "\\{(.*)$" if rules.style == "brace" else ":\\s*(\\S.*)$", 1)).otherwise(code)
    if rules.style in ("keyword", "sql"):
        body = F.when(F.col("is_def"), F.lit("")).otherwise(code)
    marked = sorted_join(lines.where(code.contains("(") | code.contains("new")), def_lines.distinct(), ["path", "n"], "left").withColumn("body", body)
    creations = F.regexp_extract_all("body", F.lit("\\bnew\\s+(\\w+)"), F.lit(1)) if lang in ("java", "ts") else F.array().cast("array<string>")
    plain = F.regexp_replace("body", "\\bnew\\s+\\w+(?:<[^>]*>)?\\s*\\(", " (") if lang != "vb" else F.col("body")
    pairs = F.arrays_zip(
        F.regexp_extract_all(plain, F.lit(rules.call), F.lit(1)).alias("o"), F.regexp_extract_all(plain, F.lit(rules.call), F.lit(2)).alias("t")
    )
    level = F.when(F.col("is_def"), F.col("level") + 1).otherwise(F.greatest("level", "after")).alias("level")
    base = marked.select("path", "n", level, F.concat_ws("#", "path", "n").alias("item"), pairs.alias("pairs"), creations.alias("made"))
    base = base.where(F.size("pairs") + F.size("made") > 0)
    around = F.col("around")
    last_function = F.filter(around, lambda d: d["kind"].isin("function", "constructor"))
    inside = enclosing(base, defs).where(F.size(last_function) > 0).withColumn("def_line", F.get(last_function, F.size(last_function) - 1)["n"])
    inside = sorted_join(sorted_join(inside, owner, ["path", "def_line"]), spaces, "path", "left").withColumn("class_line", innermost(around, "class")["n"])
    inside = sorted_join(inside, klass, ["path", "class_line"], "left")
    cols = ["path", "src", "around", "file_space", "class_line", "class_fqn"]
    if lang in ("java", "ts"):
        inside = cut_in_place(inside.select(*cols, "pairs", "made"))
    calls = inside.select(*cols, F.explode("pairs").alias("c")).select(*cols, F.col("c.o").alias("object"), F.col("c.t").alias("target"))
    if rules.statements:
        calls = calls.where(~F.lower("target").isin(*rules.statements))
    object_, target = F.col("object"), F.col("target")
    last_class = innermost(around, "class")["name"]
    if lang == "vb":
        return calls.select("src", target.alias("dst"), F.lit("CALLS").alias("type"))
    if lang == "sql":
        return calls.select("src", F.concat("path", F.lit(":"), target).alias("dst"), F.lit("CALLS").alias("type"))
    if lang == "python":
        rows = _resolved(calls, imports, "object", "scope", object_)
        rows = _resolved(rows, imports, "target", "bare", target)
        local = F.when((object_ == "self") & last_class.isNotNull(), F.concat(last_class, F.lit("."), target)).when(
            object_ != "", F.concat("scope", F.lit("."), target)
        ).otherwise(F.col("bare"))
        return rows.select("src", F.concat(F.lit("Function:"), "path", F.lit(":"), local, F.lit(":")).alias("dst"), F.lit("CALLS").alias("type"))
    known = fields.groupBy("path", "class_line", "field").agg(F.max("ftype").alias("ftype"))
    calls = sorted_join(calls.withColumn("field", F.regexp_replace("object", "^this\\.", "")), known, ["path", "class_line", "field"], "left")
    if lang == "cs":
        calls = cut_in_place(calls)
        by_field = calls.where("ftype is not null")
        rest = calls.where("ftype is null")
        return _candidates(by_field, usings, "ftype", "CALLS", F.concat(F.lit("."), target)).unionByName(_candidates(rest, usings, "target", "CALLS"))
    made = inside.select(*cols, F.explode("made").alias("target"))
    if lang == "java":
        rows = _resolved(calls, imports, "object", "scope", _java_type(object_))
        dst = F.when(object_.isin("", "this"), F.concat("class_fqn", F.lit("."), target)).otherwise(F.concat(F.coalesce("ftype", "scope"), F.lit("."), target))
        new = _resolved(made, imports, "target", "dst", _java_type(target))
        return rows.select("src", dst.alias("dst"), F.lit("CALLS").alias("type")).unionByName(new.select("src", "dst", F.lit("CALLS").alias("type")))
    both = calls.select(*cols, "object", "target", "ftype").unionByName(made.select(*cols, F.lit("").alias("object"), "target", F.lit(None).cast("string").alias("ftype")))
    rows = _resolved(both, imports, "target", "bare", F.concat("path", F.lit(":"), target))
    dst = F.when((object_ == "this") & last_class.isNotNull(), F.concat("path", F.lit(":"), last_class, F.lit("."), target)).when(
        F.col("ftype").isNotNull(), F.concat("ftype", F.lit("."), target)
    ).otherwise(F.col("bare"))
    return rows.select("src", dst.alias("dst"), F.lit("CALLS").alias("type"))


def extract(files: DataFrame, languages: tuple[str, ...] | None = None) -> PropertyGraph:
    """Unresolved graph of ``files(path, text)``: files, definitions and references.

    Edge targets may be qualified names; loading resolves them. Unsupported files are
    left out.
    """
    known = supported(files)
    parts = shares(known, FILES)
    ready = cut_in_place(prepare(known.repartition(parts, "path")))
    langs = languages or tuple(r["lang"] for r in ready.select("lang").distinct().collect())
    file_test = is_test_file(F.col("path"))
    file_nodes = ready.select(
        F.col("path").alias("id"), F.lit("File").alias("label"), F.col("path").alias("name"), F.col("path").alias("file"),
        F.when(file_test, F.lit(True)).alias("is_test"),
        F.when(F.col("lang") == "vb", F.create_map(F.lit("lang"), F.lit("vbnet"))).alias("extra"),
    )
    nodes, edges = [conform_nodes(file_nodes)], []
    shifts = ready.select(F.col("path").alias("file"), "shift")
    for lang in langs:
        rows, refs = _extract(ready, lang, parts)
        rows = sorted_join(rows, shifts, "file").withColumn("start_line", F.col("start_line") - F.col("shift"))
        test = F.when(is_test_file(F.col("file")) & F.col("label").isin("Function", "Method"), F.lit(True)).otherwise(F.col("is_test"))
        rows = rows.withColumn("is_test", test).withColumn("extra", F.when(F.coalesce("sig", F.lit("")) != "", F.create_map(F.lit("signature"), F.col("sig"))))
        nodes.append(conform_nodes(rows))
        located = rows.where(F.col("label").isin("Function", "Method", "Class")).select(F.col("id").alias("src"), F.col("file").alias("dst"), F.lit("DEFINED_IN").alias("type"))
        edges += [located, refs.select("src", "dst", "type")]
    none = ready.sparkSession.createDataFrame([], "src string, dst string, type string")
    return PropertyGraph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges, none))
