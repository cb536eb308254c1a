"""Entry points: one function per report and per pipeline step.

Extractors, embedders and summarisers take columns and return a column, so a built-in
expression, a pandas UDF and a service client behind one fit alike. Given the folder of a log they
are Python functions, called row by row in batches that are kept, so that a run can be resumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import DEFAULT_LINES, node_to_text, pattern_in_scope, slice_lines
from graphloom.model import PropertyGraph
from graphloom.operators import backlog, domains, history, neighborhood, paths, pinch, search, similarity, structure
from graphloom.operators import volatility, whatif
from graphloom.operators.lookup import resolve_one
from graphloom.operators.resumable import answer_rows
from graphloom.operators.testlinks import link_tests


def run_sql(graph: PropertyGraph, statement: str) -> DataFrame:
    """A read-only SQL query over ``nodes``, with nulls for embeddings, and ``edges``.

    The statement stands in brackets, where the grammar takes a query and nothing that writes;
    the two frames are views under names of their own, so that no view of the caller is touched.
    """
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("nodes", "edges")]
    graph.public_nodes().withColumn("embedding", F.lit(None).cast("array<float>")).createOrReplaceTempView(names[0])
    graph.edges.createOrReplaceTempView(names[1])
    try:
        return graph.spark.sql(f"WITH nodes AS (TABLE {names[0]}), edges AS (TABLE {names[1]}) SELECT * FROM (\n{statement}\n)").drop("embedding")
    except ParseException as error:
        raise ValueError(f"only read-only queries are accepted: {error}") from error
    finally:
        for name in names:
            graph.spark.catalog.dropTempView(name)


def fetch_source(graph: PropertyGraph, node: str, sources: DataFrame) -> DataFrame:
    """Source text of the first node a reference names, from ``sources(file, text)``.

    Without line numbers the first fifty lines are returned.
    """
    hit = graph.nodes.join(resolve_one(graph, node), "id", "left_semi").select("id", "file", "start_line", "end_line")
    start, end = F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0))
    bare = (start == 0) & (end == 0)
    content = slice_lines(F.col("text"), F.when(bare, 1).otherwise(start), F.when(bare, DEFAULT_LINES).otherwise(end))
    return hit.join(sources.select("file", "text"), "file").select("id", "file", content.alias("content"))


def locate_usage(graph: PropertyGraph, source: str, target: str, sources: DataFrame, context: int = 0) -> DataFrame:
    """Numbered lines of ``source`` that mention the name of ``target``, with ``context`` lines about each.

    A source without a file or line numbers yields nothing.
    """
    name = graph.nodes.join(resolve_one(graph, target), "id", "left_semi").select(F.col("name").alias("target_name")).first()
    if name is None or name[0] is None:
        raise LookupError("target node not found")
    hit = graph.nodes.join(resolve_one(graph, source), "id", "left_semi").where(
        "coalesce(file, '') <> '' and coalesce(start_line, 0) <> 0 and coalesce(end_line, 0) <> 0"
    )
    body = slice_lines(F.col("text"), F.col("start_line"), F.col("end_line"))
    found = hit.select("file", "start_line", "end_line").join(sources.select("file", "text"), "file")
    marks = pattern_in_scope(body, F.lit(name[0]), context, F.col("start_line"))
    rows = found.select(F.explode(F.flatten(marks)).alias("m"))
    return rows.select(F.col("m.number").alias("line_number"), F.col("m.content").alias("content"))


_REPORTS: dict[str, Callable] = {
    "traverse": lambda g, p: paths.traverse(g, p["target"], p.get("edge_types", ""), p.get("direction", "outgoing"), p.get("depth", 1)),
    "semantic-trace": lambda g, p: paths.semantic_trace(g, p["target"]),
    "neighbors": lambda g, p: paths.neighbors(g, p["target"], p.get("depth", 1), p.get("limit", 10)),
    "callers": lambda g, p: neighborhood.callers(g, p["target"]),
    "impact": lambda g, p: neighborhood.impact(g, p["target"], p.get("depth", 1)),
    "globals": lambda g, p: neighborhood.globals_used(g, p["target"]),
    "coverage": lambda g, p: neighborhood.coverage(g, p["target"]),
    "seams": lambda g, p: pinch.seams(g, p.get("module", ".*"), p.get("layer", "ui")),
    "hotspots": lambda g, p: pinch.hotspots(g, p.get("module", ".*")),
    "search-similar": lambda g, p: search.search_similar(g, p["target"], p.get("vector"), p.get("limit", 10)),
    "search-features": lambda g, p: search.search_features(g, p["target"], p.get("vector"), p.get("limit", 10)),
    "search-all": lambda g, p: search.search_all(g, p["target"], p.get("vector"), p.get("limit", 10)),
    "hybrid-context": lambda g, p: neighborhood.hybrid_context(
        paths.neighbors(g, p["target"], p.get("depth", 1), p.get("limit", 10)),
        search.search_similar(g, p["target"], p.get("vector"), p.get("limit", 10)),
    ),
    "duplicates": lambda g, p: similarity.find_duplicates(g, p.get("similarity", 0.5), p.get("limit", 10)),
    "semantic-seams": lambda g, p: similarity.semantic_seams(g, p.get("similarity", 0.5)),
    "explore-domain": lambda g, p: structure.explore_domain(g, p["target"]),
    "what-if": lambda g, p: whatif.what_if(g, p["targets"]),
    "overview": lambda g, p: structure.overview(g),
    "status": lambda g, p: structure.graph_stats(g).withColumn("commit", F.lit(structure.graph_state(g).first()[0])),
    "fetch-source": lambda g, p: fetch_source(g, p["target"], p["sources"]),
    "locate-usage": lambda g, p: locate_usage(g, p["target"], p["target2"], p["sources"], p.get("context", 0)),
    "sql": lambda g, p: run_sql(g, p["query"]),
}
_REPORTS["features"] = _REPORTS["search-features"]
_REPORTS["test-context"] = _REPORTS["neighbors"]


def run_query(graph: PropertyGraph, kind: str, summary: bool = False, **params):
    """A report by name; ``summary`` gives row counts instead of rows."""
    if kind not in _REPORTS:
        raise ValueError(f"unknown query {kind!r}; one of {', '.join(sorted(_REPORTS))}")
    result = _REPORTS[kind](graph, params)
    if not summary:
        return result
    return neighborhood.summarize(result if isinstance(result, dict) else {kind: result})


# ---- pipeline steps --------------------------------------------------------------------


def enrich_history(graph: PropertyGraph, touches: DataFrame) -> PropertyGraph:
    return history.update_file_history(graph, history.file_history(touches))


def enrich_contamination(graph: PropertyGraph) -> PropertyGraph:
    """Propagate volatility and score risk; needs at least one volatile function."""
    if graph.labelled("Function").where("is_volatile").isEmpty():
        raise pinch.MissingData("no volatile functions: seed volatility or extract features first")
    return volatility.with_risk(volatility.propagate_volatility(graph))


DESCRIBED = "features array<string>, is_volatile boolean"
EMBEDDED = "embedding array<float>"
SUMMARIZED = "name string, description string"


def _answered(rows: DataFrame, arguments: dict[str, Column], answer: str, callable_, log: str | None, how: dict) -> DataFrame:
    """``id`` and the fields of ``answer``: from a column, or from a Python callable through a log that can be resumed."""
    asked = rows.select("id", *(c.alias(name) for name, c in arguments.items()))
    if log is None:
        given = callable_(*(F.col(name) for name in arguments))
        # One field is the column itself, several are a struct.
        one = answer.split()[0] if "," not in answer else None
        return asked.select("id", given.alias(one)) if one else asked.select("id", given.alias("a")).select("id", "a.*")
    names, fields = list(arguments), [f.split()[0] for f in answer.split(", ")]

    def call(row: dict) -> dict:
        found = callable_(*(row[name] for name in names))
        found = (found,) if len(fields) == 1 else found
        return dict(zip(fields, (list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else v for v in found)))

    return answer_rows(asked, call, answer, log, **how)


def extract_features(graph: PropertyGraph, sources: DataFrame, extractor, log: str | None = None, **how) -> PropertyGraph:
    """Descriptors for functions that have none.

    ``extractor(code, name)`` returns a column ``struct<features array<string>, is_volatile
    boolean>``. Functions without a location become ``unknown``, unreadable files
    ``unreadable_source``, an empty answer ``no_features_detected``.

    With a ``log`` folder the extractor is a Python function that returns these two values, called row by row in
    batches that are kept (see ``resumable.answer_rows`` and its parameters): functions it fails for stay without descriptors.
    """
    todo = backlog.unextracted(graph).join(sources.select("file", "text"), "file", "left")
    start, end = F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0))
    located = (F.coalesce("file", F.lit("")) != "") & (start != 0) & (end != 0)
    code = slice_lines(F.col("text"), start, end)
    rows = todo.select("id", "name", located.alias("located"), F.col("text").isNotNull().alias("readable"), code.alias("code"))
    lost = rows.where(~(F.col("located") & F.col("readable"))).select(
        "id", F.array(F.when(~F.col("located"), "unknown").otherwise("unreadable_source")).alias("atomic_features"), F.lit(False).alias("is_volatile")
    )
    answers = _answered(rows.where("located and readable"), {"code": F.col("code"), "name": F.col("name")}, DESCRIBED, extractor, log, how)
    found = answers.select(
        "id", F.when(F.coalesce(F.size("features"), F.lit(0)) <= 0, F.array(F.lit("no_features_detected"))).otherwise(F.col("features")).alias("atomic_features"),
        F.coalesce("is_volatile", F.lit(False)).alias("is_volatile"),
    )
    return backlog.update_atomic_features(graph, lost.unionByName(found))


def embed_nodes(graph: PropertyGraph, embedder, log: str | None = None, **how) -> PropertyGraph:
    """Vectors for functions and features that have none; ``embedder(text)`` is a column, or with a ``log`` a Python function."""
    todo = backlog.unembedded(graph)
    text = node_to_text(F.col("file"), F.col("name"), F.col("atomic_features"), F.col("id"))
    answers = _answered(todo, {"text": text}, EMBEDDED, embedder, log, how)
    return backlog.update_embeddings(graph, answers.select("id", F.col("embedding").cast("array<float>").alias("embedding")))


def summarize_features(graph: PropertyGraph, sources: DataFrame, summarizer, log: str | None = None, **how) -> PropertyGraph:
    """Names and descriptions for unnamed features and domains.

    ``summarizer(snippets, label)`` returns ``struct<name string, description string>``, or with a ``log`` is a Python function that returns the two.
    """
    under = structure.functions_under(graph)
    functions = graph.labelled("Function").select(
        F.col("id").alias("function_id"), "file", "start_line", "end_line", "atomic_features"
    )
    todo = backlog.unnamed(graph).select(F.col("id").alias("feature_id"), "label")
    rows = todo.join(under, "feature_id").join(functions, "function_id").join(sources.select("file", "text"), "file", "left")
    code = slice_lines(F.col("text"), F.col("start_line"), F.col("end_line"))
    snippets = domains.feature_snippets(rows.select("feature_id", F.col("function_id").alias("id"), code.alias("code"), "atomic_features"))
    # At most eleven snippets of bounded length per feature.
    gathered = snippets.groupBy("feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "snippet"))), lambda s: s["snippet"]).alias("snippets"))
    asked = todo.join(gathered, "feature_id").select(F.col("feature_id").alias("id"), "snippets", "label")
    answers = _answered(asked, {"snippets": F.col("snippets"), "label": F.col("label")}, SUMMARIZED, summarizer, log, how)
    return backlog.update_summaries(graph, answers.select("id", "name", "description"))


def enrich_features(graph: PropertyGraph, sources: DataFrame, extractor, embedder, summarizer, root: str = ".", seed: int = 42) -> PropertyGraph:
    """Descriptors, vectors, topology and names in that order."""
    described = extract_features(graph, sources, extractor).settle()
    embedded = embed_nodes(described, embedder).settle()
    clustered = domains.run_clustering(embedded, root, seed).settle()
    return summarize_features(clustered, sources, summarizer)


def build_all(graph: PropertyGraph, sources: DataFrame, touches: DataFrame, extractor, embedder, summarizer, commit: str = "") -> PropertyGraph:
    """Features, history, contamination, tests: the whole chain over a loaded graph."""
    graph = enrich_features(graph, sources, extractor, embedder, summarizer).settle()
    graph = enrich_history(graph, touches).settle()
    graph = link_tests(enrich_contamination(graph)).settle()
    return structure.update_graph_state(graph, commit)
