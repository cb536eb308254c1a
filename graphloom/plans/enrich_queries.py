"""Queries over enrichment, loading, work lists, topology and incremental updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.api import fetch_source as fetch_node_source
from graphloom.api import locate_usage as locate_node_usage
from graphloom.functions.text import (
    common_ancestor, domain_names, dominant_terms, json_in_text, node_to_text, pattern_in_scope, slice_lines,
)
from graphloom.model import PropertyGraph, conform_nodes
from graphloom.operators import backlog, history, incremental, neighborhood, testlinks, topology
from graphloom.operators.upsert import upsert_edges, upsert_nodes
from graphloom.plans.catalog import query
from graphloom.plans.retail import (
    CHURN_SQL, INCLUDE_SQL, TOUCH_SQL, Tables, function_rows, graph_sql, include_graph, retail_graph, text, touches,
)
from graphloom.sources import gitlog, jsonl

# ---- history ---------------------------------------------------------------------------


_CO_PARTS = """
    pairs AS (SELECT a.file, b.file AS other, count(*) AS n FROM touches a JOIN touches b
              ON a."commit" = b."commit" AND a.rid <> b.rid GROUP BY ALL HAVING count(*) >= 3),
    top AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, other) AS r FROM pairs)"""
_CO_SQL = f"""WITH {TOUCH_SQL}, {_CO_PARTS}
    SELECT file, string_agg(other, ',' ORDER BY r) AS co_changes FROM top WHERE r <= 5 GROUP BY file"""


@query(
    "file_history",
    f"""WITH {TOUCH_SQL}, {CHURN_SQL}, {_CO_PARTS}, best AS (SELECT file, string_agg(other, ',' ORDER BY r) AS co FROM top WHERE r <= 5 GROUP BY file)
    SELECT churn.file, churn AS change_frequency, last_changed, coalesce(co, '') AS co_changes FROM churn LEFT JOIN best ON best.file = churn.file""",
)
def file_history(t: Tables) -> DataFrame:
    """Churn, last change and companions of every file."""
    return history.file_history(touches(t)).withColumn("co_changes", F.array_join("co_changes", ","))


@query("co_changes", _CO_SQL)
def co_changes(t: Tables) -> DataFrame:
    return history.co_changes(touches(t)).select("file", F.array_join("co_changes", ",").alias("co_changes"))


@query("co_changes_wide_commits", _CO_SQL)
def co_changes_wide(t: Tables) -> DataFrame:
    """The same with every commit of more than two files handled as a wide one."""
    return history.co_changes(touches(t), wide=2).select("file", F.array_join("co_changes", ",").alias("co_changes"))


@query(
    "update_file_history",
    f"""WITH {TOUCH_SQL}, {CHURN_SQL} SELECT f.file, h.churn AS change_frequency, h.last_changed
    FROM (SELECT DISTINCT p_brand AS file FROM part) f LEFT JOIN churn h USING (file)""",
)
def update_file_history(t: Tables) -> DataFrame:
    fresh = history.file_churn(touches(t)).withColumn("co_changes", F.array().cast("array<string>"))
    g = history.update_file_history(retail_graph(t), fresh)
    return g.labelled("File").select("file", "change_frequency", "last_changed")


@query(
    "parse_git_log",
    f"WITH {TOUCH_SQL}, {CHURN_SQL} SELECT file, churn AS change_frequency, last_changed FROM churn",
)
def parse_git_log(t: Tables) -> DataFrame:
    """Log text written from the tables, one record per mention, then parsed back."""
    records = touches(t).select("commit", F.concat("changed_at", F.lit("\n\n"), "file", F.lit("\r\n")).alias("value"))
    return history.file_churn(gitlog.touched(records))


# ---- tests -----------------------------------------------------------------------------


def graph_with_tests(t: Tables) -> PropertyGraph:
    """Functions, and a test for each small part that names it in one of three ways."""
    own = F.concat("p_name", F.lit(" "), F.floor(F.col("p_partkey") / 100).cast("string"))
    way = F.col("p_partkey") % 3
    name = F.when(way == 0, F.concat(F.lit("Test"), own)).when(way == 1, F.concat(own, F.lit("Test"))).otherwise(F.concat(own, F.lit("Tests")))
    tests = t.part.where("p_size <= 3").select(
        text("test:", "p_partkey").alias("id"), F.lit("Method").alias("label"), name.alias("name"), F.lit(True).alias("is_test")
    )
    return PropertyGraph(conform_nodes(function_rows(t)).unionByName(conform_nodes(tests)), edge_parts={
        "DEFINED_IN": lambda: t.part.selectExpr("concat('fn:', p_partkey) as src", "concat('file:', p_brand) as dst")})


_LINKS = "links AS (SELECT 'test:' || t.p_partkey AS test_id, p.id AS prod_id FROM part t JOIN fn p ON p.name = t.p_name || ' ' || (t.p_partkey // 100) WHERE t.p_size <= 3)"


@query("link_tests", graph_sql("SELECT test_id, prod_id FROM links", _LINKS))
def link_tests(t: Tables) -> DataFrame:
    return testlinks.test_links(graph_with_tests(t))


@query("coverage", graph_sql("SELECT test_id AS id, 'Method' AS label FROM links JOIN fn ON fn.id = prod_id AND is_volatile GROUP BY test_id", _LINKS))
def coverage(t: Tables) -> DataFrame:
    """Tests of any volatile function."""
    g = testlinks.link_tests(graph_with_tests(t))
    volatile = g.nodes.where("is_volatile").select(F.col("id").alias("ref"))
    return neighborhood.coverage(g, volatile).distinct()


# ---- work lists ------------------------------------------------------------------------


def embedded_graph(t: Tables) -> PropertyGraph:
    """Functions with the vectors there are; features without."""
    vectors = t.embeddings.select(F.concat(F.lit("fn:"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    g = retail_graph(t)
    functions = conform_nodes(function_rows(t)).drop("embedding").join(vectors, "id", "left")
    return g.with_part("Function", functions)


_EMBEDDED = "emb AS (SELECT 'fn:' || vec_id AS id FROM embeddings)"
_USABLE = "af IS NOT NULL AND NOT (len(af) = 1 AND af[1] = 'unknown')"


@query("unextracted", graph_sql("SELECT id FROM fn WHERE af IS NULL AND start_line IS NOT NULL"))
def unextracted(t: Tables) -> DataFrame:
    return backlog.unextracted(retail_graph(t)).select("id")


@query("unextracted_count", graph_sql("SELECT count(*) AS count FROM fn WHERE af IS NULL AND start_line IS NOT NULL"))
def unextracted_count(t: Tables) -> DataFrame:
    return backlog.counted(backlog.unextracted(retail_graph(t)))


@query("unembedded", graph_sql("SELECT id FROM nodes WHERE label IN ('Function', 'Feature') AND id NOT IN (FROM emb)", _EMBEDDED))
def unembedded(t: Tables) -> DataFrame:
    return backlog.unembedded(embedded_graph(t)).select("id")


@query("unembedded_count", graph_sql("SELECT count(*) AS count FROM nodes WHERE label IN ('Function', 'Feature') AND id NOT IN (FROM emb)", _EMBEDDED))
def unembedded_count(t: Tables) -> DataFrame:
    return backlog.counted(backlog.unembedded(embedded_graph(t)))


_UNNAMED = "FROM nodes WHERE label IN ('Feature', 'Domain') AND (coalesce(name, '') = '' OR coalesce(description, '') = '')"


@query("unnamed", graph_sql(f"SELECT id {_UNNAMED}"))
def unnamed(t: Tables) -> DataFrame:
    return backlog.unnamed(retail_graph(t)).select("id")


@query("unnamed_count", graph_sql(f"SELECT count(*) AS count {_UNNAMED}"))
def unnamed_count(t: Tables) -> DataFrame:
    return backlog.counted(backlog.unnamed(retail_graph(t)))


@query("embeddings_only", graph_sql(f"SELECT id FROM fn WHERE {_USABLE} AND id IN (FROM emb)", _EMBEDDED))
def embeddings_only(t: Tables) -> DataFrame:
    return backlog.embeddings_only(embedded_graph(t)).select("id")


@query(
    "function_metadata",
    graph_sql(f"SELECT id, name, file, start_line, end_line, array_to_string(af, ',') AS features FROM fn WHERE {_USABLE}"),
)
def function_metadata(t: Tables) -> DataFrame:
    rows = backlog.function_metadata(retail_graph(t))
    return rows.select("id", "name", "file", "start_line", "end_line", F.array_join("atomic_features", ",").alias("features"))


@query(
    "update_atomic_features",
    graph_sql(
        """SELECT id, CASE WHEN af IS NULL AND start_line IS NOT NULL THEN 'no_features_detected' ELSE array_to_string(af, ',') END AS features,
        CASE WHEN af IS NULL AND start_line IS NOT NULL THEN false ELSE is_volatile END AS is_volatile FROM fn"""
    ),
)
def update_atomic_features(t: Tables) -> DataFrame:
    g = retail_graph(t)
    updates = backlog.unextracted(g).select("id", F.array(F.lit("no_features_detected")).alias("atomic_features"), F.lit(False).alias("is_volatile"))
    done = backlog.update_atomic_features(g, updates)
    return done.labelled("Function").select("id", F.array_join("atomic_features", ",").alias("features"), "is_volatile")


@query("update_embeddings", graph_sql("SELECT count(*) AS count FROM nodes WHERE label IN ('Function', 'Feature') AND id NOT IN (FROM emb)", _EMBEDDED))
def update_embeddings(t: Tables) -> DataFrame:
    """Unembedded before, all embedded after: how many were filled in."""
    g = embedded_graph(t)
    todo = backlog.unembedded(g).select("id", F.array(F.lit(0.5), F.lit(0.25)).cast("array<float>").alias("embedding"))
    done = backlog.update_embeddings(g, todo)
    return done.nodes.where("size(embedding) = 2").agg(F.count("*").alias("count"))


@query(
    "update_summary",
    graph_sql(
        """SELECT id, CASE WHEN label = 'Feature' AND coalesce(description, '') = '' THEN upper(name) ELSE name END AS name,
        CASE WHEN label = 'Feature' AND coalesce(description, '') = '' THEN 'covers ' || name ELSE description END AS description
        FROM nodes WHERE label IN ('Feature', 'Domain')"""
    ),
)
def update_summary(t: Tables) -> DataFrame:
    g = retail_graph(t)
    todo = backlog.unnamed(g).select("id", F.upper("name").alias("name"), F.concat(F.lit("covers "), "name").alias("description"))
    return backlog.update_summaries(g, todo).labelled("Feature", "Domain").select("id", "name", "description")


# ---- topology --------------------------------------------------------------------------


@query(
    "clear_topology",
    graph_sql(
        """SELECT 'nodes' AS part, count(*) AS count FROM nodes WHERE label NOT IN ('Feature', 'Domain')
        UNION ALL SELECT 'edges', count(*) FROM edges WHERE type NOT IN ('PARENT_OF', 'IMPLEMENTS')"""
    ),
)
def clear_topology(t: Tables) -> DataFrame:
    return incremental.remaining_counts(topology.clear_topology(retail_graph(t)))


@query(
    "update_topology",
    """SELECT 'feat:' || n_nationkey AS id, 'Feature' AS label, CASE WHEN n_nationkey < 30 THEN 'new ' || n_name ELSE n_name END AS name,
       (SELECT count(*) FROM (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier) s WHERE s.s_nationkey = n.n_nationkey) AS members FROM nation n""",
)
def update_topology(t: Tables) -> DataFrame:
    """Every nation renamed; a member edge per supplier, and one dangling edge each."""
    g = PropertyGraph(retail_graph(t).labelled("Feature", "Global"), t.spark.createDataFrame([], "src string, dst string, type string"))
    nodes = conform_nodes(t.nation.select(text("feat:", "n_nationkey").alias("id"), F.lit("Feature").alias("label"), F.concat(F.lit("new "), "n_name").alias("name")))
    edges = t.supplier.select(text("gv:", "s_suppkey").alias("src"), text("feat:", "s_nationkey").alias("dst"), F.lit("IMPLEMENTS").alias("type")).unionByName(
        t.nation.select(F.lit("gv:none").alias("src"), text("feat:", "n_nationkey").alias("dst"), F.lit("IMPLEMENTS").alias("type"))
    )
    done = topology.update_topology(g, nodes, edges)
    members = done.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("members"))
    return done.labelled("Feature").select("id", "label", "name").join(members, "id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


# ---- loading ---------------------------------------------------------------------------


def event_lines(t: Tables) -> DataFrame:
    """Every event as a JSON node record of its user, in event order."""
    kind = F.col("event_type")
    record = F.struct(
        text("user:", "user_id").alias("id"), F.lit("User-Agent").alias("type"),
        F.when(kind != "error", kind).alias("name"), (F.col("event_id") + 1).alias("start_line"),
        F.get_json_object("props", "$.k").alias("k"), F.when(kind == "click", F.col("event_id")).alias("clicked"),
    )
    return t.events.select(F.to_json(record).alias("value"), F.col("event_id").alias("seq"))


@query(
    "load_nodes",
    """SELECT 'user:' || user_id AS id, 'UserAgent' AS label, arg_max(CASE WHEN event_type <> 'error' THEN event_type END,
       CASE WHEN event_type <> 'error' THEN event_id END) AS name, max(event_id) + 1 AS start_line,
       arg_max(json_extract_string(props, '$.k'), event_id) AS k, max(CASE WHEN event_type = 'click' THEN event_id END)::VARCHAR AS clicked
       FROM events GROUP BY user_id""",
)
def load_nodes(t: Tables) -> DataFrame:
    bad = t.region.select(F.lit("{not json").alias("value"), F.lit(-5).cast("bigint").alias("seq"))
    g = jsonl.load_graph(event_lines(t).unionByName(bad))
    return g.nodes.select("id", "label", "name", "start_line", F.col("extra")["k"].alias("k"), F.col("extra")["clicked"].alias("clicked"))


@query(
    "load_edges",
    graph_sql(
        """SELECT DISTINCT 'fn:' || l_partkey AS src, fn.id AS dst, CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'RELATED_TO' ELSE 'usesit' END AS type
        FROM lineitem JOIN fn ON fn.id = 'fn:' || (l_partkey + l_linenumber)"""
    ),
)
def load_edges(t: Tables) -> DataFrame:
    """Edge records whose target is an id or a qualified name; some point nowhere."""
    far = (F.col("l_partkey") + F.col("l_linenumber")).cast("string")
    record = F.struct(
        text("fn:", "l_partkey").alias("source"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("part."), far)).otherwise(F.concat(F.lit("fn:"), far)).alias("target"),
        F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "").otherwise("uses-it").alias("type"),
    )
    nodes = t.part.select(F.to_json(F.struct(text("fn:", "p_partkey").alias("id"), F.lit("Function").alias("type"), text("part.", "p_partkey").alias("fqn"))).alias("value"))
    lines = nodes.unionByName(t.lineitem.select(F.to_json(record).alias("value"))).withColumn("seq", F.lit(0).cast("bigint"))
    return jsonl.load_graph(lines).edges


@query("jsonl_round_trip", graph_sql("SELECT id, label, name, file, start_line, array_to_string(af, ',') AS features FROM fn"))
def jsonl_round_trip(t: Tables) -> DataFrame:
    """Functions written as JSON text and read back."""
    lines = jsonl.node_lines(conform_nodes(function_rows(t))).withColumn("seq", F.lit(0).cast("bigint"))
    rows = jsonl.load_graph(lines).nodes
    return rows.select("id", "label", "name", "file", "start_line", F.array_join("atomic_features", ",").alias("features"))


@query(
    "upsert_edges",
    graph_sql(
        """SELECT type, count(*) AS count FROM (SELECT src, dst, type FROM steps UNION SELECT 'fn:' || l_partkey, 'gv:' || l_suppkey, 'BUYS' FROM lineitem) GROUP BY type"""
    ),
)
def merge_edges(t: Tables) -> DataFrame:
    g = retail_graph(t)
    base = PropertyGraph(g.labelled("Function", "Global"), g.of_type("CALLS", "USES", "DEPENDS_ON"))
    more = t.lineitem.select(text("fn:", "l_partkey").alias("src"), text("gv:", "l_suppkey").alias("dst"), F.lit("BUYS").alias("type"))
    return upsert_edges(base, more).edges.groupBy("type").agg(F.count("*").alias("count"))


@query(
    "upsert_nodes",
    graph_sql("SELECT id, coalesce(upper(CASE WHEN is_volatile THEN name END), name) AS name, file FROM fn"),
)
def merge_nodes_query(t: Tables) -> DataFrame:
    """Volatile functions get a new name; what the update leaves out stays."""
    g = PropertyGraph(retail_graph(t).labelled("Function"), None)
    update = conform_nodes(g.nodes.where("is_volatile").select("id", "label", F.upper("name").alias("name"))).withColumn("seq", F.lit(1).cast("bigint"))
    return upsert_nodes(g, update).nodes.select("id", "name", "file")


# ---- incremental -----------------------------------------------------------------------

_AFFECTED = """hit AS (SELECT 'c' || c_custkey AS file FROM customer WHERE c_acctbal < -900
    UNION SELECT inc.src FROM hit JOIN inc ON inc.dst = hit.file),
    affected AS (SELECT file FROM hit UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9900)"""


def _changed(t: Tables) -> tuple[DataFrame, DataFrame]:
    files = t.customer.select(text("c", "c_custkey").alias("file"), "c_acctbal")
    return files.where("c_acctbal < -900").select("file"), files.where("c_acctbal > 9900").select("file")


@query("include_closure", f"WITH RECURSIVE {INCLUDE_SQL}, {_AFFECTED} SELECT file FROM affected")
def include_closure(t: Tables) -> DataFrame:
    return incremental.affected_files(include_graph(t), *_changed(t))


@query(
    "delete_affected",
    f"""WITH RECURSIVE {INCLUDE_SQL}, {_AFFECTED}
    SELECT 'nodes' AS part, count(*) AS count FROM customer WHERE 'c' || c_custkey NOT IN (FROM affected)
    UNION ALL SELECT 'edges', count(*) FROM inc WHERE src NOT IN (FROM affected) AND dst NOT IN (FROM affected)""",
)
def delete_affected(t: Tables) -> DataFrame:
    g = include_graph(t)
    return incremental.remaining_counts(incremental.delete_affected(g, incremental.affected_files(g, *_changed(t))))


# ---- text ------------------------------------------------------------------------------


@query(
    "node_to_text",
    graph_sql(
        """SELECT id, CASE WHEN concat_ws('', file, name, array_to_string(af, ', ')) = '' THEN id
        ELSE concat_ws(' | ', nullif(file, ''), nullif(name, ''), nullif(array_to_string(af, ', '), '')) END AS text FROM nodes"""
    ),
)
def node_text(t: Tables) -> DataFrame:
    g = retail_graph(t)
    return g.nodes.select("id", node_to_text(F.col("file"), F.col("name"), F.col("atomic_features"), F.col("id")).alias("text"))


def file_paths(t: Tables) -> DataFrame:
    """Order paths by customer segment; urgent segments share a directory."""
    deep = F.concat(F.lit("src//"), F.lower("c_mktsegment"), F.lit("/./seg"), (F.col("c_nationkey") % 5).cast("string"), F.lit("/../n"), F.col("c_nationkey").cast("string"))
    return t.customer.select(
        text("n", "c_nationkey").alias("grp"), F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("/abs/"), deep)).otherwise(deep).alias("path"),
    )


_LCA = """lca AS (SELECT 'n' || c_nationkey AS grp, CASE WHEN c_nationkey % 4 = 0 THEN '/abs/' ELSE '' END || 'src' ||
    CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN '' ELSE '/' || lower(max(c_mktsegment)) || '/n' || c_nationkey END AS lca
    FROM customer GROUP BY c_nationkey)"""


@query("lca", f"WITH {_LCA} SELECT grp, lca FROM lca")
def lca(t: Tables) -> DataFrame:
    return common_ancestor(file_paths(t), ["grp"])


@query(
    "domain_name",
    graph_sql(
        """SELECT 'd' || p_size AS grp, CASE WHEN p_size % 2 = 0 THEN 'Brand' ELSE
        (SELECT upper(w[1:1]) || w[2:] FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part q WHERE q.p_size = p.p_size)
         WHERE length(w) > 2 GROUP BY w ORDER BY n DESC, w LIMIT 1)) END AS domain_name FROM (SELECT DISTINCT p_size FROM part) p"""
    ),
)
def domain_name(t: Tables) -> DataFrame:
    """A group per part size: even sizes lie in one telling directory, odd ones do not."""
    parts = t.part.select(
        text("d", "p_size").alias("grp"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.initcap("p_type")).alias("joined"),
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.initcap("p_type")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("src/brand/"), "p_brand")).otherwise(F.concat(F.lit("src/"), "p_brand")).alias("path"),
    )
    two = parts.select("grp", F.explode(F.array(F.col("path"), F.regexp_replace("path", "[^/]+\\z", "other"))).alias("path"))
    named = domain_names(common_ancestor(two, ["grp"]), dominant_terms(parts, ["grp"]), ["grp"])
    return named.select("grp", "domain_name")


@query(
    "fetch_source",
    """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS content FROM documents""",
)
def fetch_source(t: Tables) -> DataFrame:
    """Lines two to four of every document."""
    return t.documents.select("doc_id", slice_lines(F.col("text"), F.lit(2), F.lit(4)).alias("content"))


@query(
    "locate_usage",
    """SELECT doc_id, (i + 10)::BIGINT AS line_number, line AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
       generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE contains(line, 'tion')""",
)
def locate_usage(t: Tables) -> DataFrame:
    """Numbered lines of every document that hold a word part."""
    found = pattern_in_scope(F.col("text"), F.lit("tion"), 0, F.lit(10).cast("bigint"))
    lines = t.documents.select("doc_id", F.explode(F.flatten(found)).alias("m"))
    return lines.select("doc_id", F.col("m.number").alias("line_number"), F.col("m.content").alias("content"))


def _documents(t: Tables) -> PropertyGraph:
    """A function per document; even ones have lines, odd ones none. The function ``word`` is named for a word part."""
    even = F.col("doc_id") % 2 == 0
    nodes = t.documents.select(
        text("doc:", "doc_id").alias("id"), F.lit("Function").alias("label"), text("d", "doc_id").alias("name"), text("d/", "doc_id").alias("file"),
        F.when(even, 1).alias("start_line"), F.when(even, 4).alias("end_line"),
    )
    word = t.spark.createDataFrame([("word", "Function", "tion")], "id string, label string, name string")
    return PropertyGraph(conform_nodes(nodes).unionByName(conform_nodes(word)), t.spark.createDataFrame([], "src string, dst string, type string"))


def _sources(t: Tables) -> DataFrame:
    return t.documents.select(text("d/", "doc_id").alias("file"), "text")


@query(
    "fetch_source_node",
    """WITH pick AS (SELECT max(doc_id) AS k FROM documents GROUP BY doc_id % 2)
    SELECT 'doc:' || doc_id AS id, array_to_string(list_slice(string_split(rtrim(text, chr(10)), chr(10)), 1, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 50 END), chr(10)) AS content
    FROM documents JOIN pick ON doc_id = k""",
)
def fetch_source_node(t: Tables) -> DataFrame:
    """Source of the last two documents' functions: one with lines, one with the first fifty by default."""
    g, last = _documents(t), t.documents.groupBy(F.col("doc_id") % 2).agg(F.max("doc_id").alias("k")).select("k").collect()
    found = [fetch_node_source(g, f"doc:{r['k']}", _sources(t)).select("id", "content") for r in last]
    return reduce(DataFrame.unionByName, found)


@query(
    "locate_usage_node",
    """WITH d AS (SELECT * FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents WHERE doc_id % 2 = 0)),
    l AS (SELECT unnest(list_slice(string_split(text, chr(10)), 1, 4)) AS line, generate_subscripts(list_slice(string_split(text, chr(10)), 1, 4), 1) AS i FROM d)
    SELECT o.i::BIGINT AS line_number, o.line AS content FROM l m JOIN l o ON o.i BETWEEN m.i - 1 AND m.i + 1 WHERE contains(m.line, 'tion')""",
)
def locate_usage_node(t: Tables) -> DataFrame:
    """Lines of the last function with lines that mention the name of another, with one line about each."""
    last = t.documents.where("doc_id % 2 = 0").agg(F.max("doc_id")).first()[0]
    return locate_node_usage(_documents(t), f"doc:{last}", "word", _sources(t), context=1)


@query("json_in_text", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_text(t: Tables) -> DataFrame:
    """The JSON of an event found again inside fenced prose."""
    prose = F.concat(F.lit("Sure, here you go:\n```json\n"), "props", F.lit("\n``` hope it helps"))
    return t.events.select("event_id", F.from_json(json_in_text(prose), "k bigint")["k"].alias("k"))
