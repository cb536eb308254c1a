"""Queries over the retail graph: paths, neighbourhoods, what-if, reports, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import neighborhood, paths, pinch, structure, volatility, whatif
from graphloom.operators.history import file_churn, update_file_history
from graphloom.plans.catalog import query
from graphloom.plans.retail import CHURN_SQL, TOUCH_SQL, Tables, graph_sql, retail_graph, touches

# ---- starts: the busiest nodes of the graph, found in it ------------------------------


def busiest(graph, end: str) -> str:
    """Id of the node with the most calls at one end."""
    top = (
        graph.of_type("CALLS").groupBy(F.col(end).alias("ref")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "ref").limit(1).select("ref")
    )
    return top.first()[0]


CALLER = "caller AS (SELECT src AS id FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
CALLEE = "callee AS (SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _trail_sql(start: str, moves: str, depth: int) -> str:
    return graph_sql(
        """SELECT len(e) AS path_len, array_to_string(n, '>') AS node_path,
        array_to_string(list_transform(e, lambda x: x.type), '>') AS edge_path, cur AS end_id FROM walk WHERE len(e) > 0""",
        start,
        f"moves AS ({moves})",
        f"""walk AS (SELECT id AS cur, [id] AS n, []::STRUCT(src VARCHAR, dst VARCHAR, type VARCHAR)[] AS e FROM {start.split()[0]}
        UNION ALL SELECT m.t, list_append(w.n, m.t), list_append(w.e, m.e) FROM walk w JOIN moves m ON m.a = w.cur
        WHERE len(w.e) < {depth} AND NOT list_contains(w.e, m.e))""",
        recursive=True,
    )


_EDGE = "{'src': src, 'dst': dst, 'type': type} AS e"


@query("traverse_out", _trail_sql(CALLER, f"SELECT src AS a, dst AS t, {_EDGE} FROM edges WHERE type IN ('CALLS', 'USES')", 3))
def traverse_out(t: Tables) -> DataFrame:
    g = retail_graph(t).pin("CALLS")
    return paths.traverse(g, busiest(g, "src"), "CALLS,USES", "outgoing", 3)


@query("traverse_in", _trail_sql(CALLEE, f"SELECT dst AS a, src AS t, {_EDGE} FROM edges WHERE type = 'CALLS'", 3))
def traverse_in(t: Tables) -> DataFrame:
    g = retail_graph(t).pin("CALLS")
    return paths.traverse(g, busiest(g, "dst"), "CALLS", "incoming", 3)


@query(
    "traverse_both",
    _trail_sql(
        CALLER,
        f"SELECT src AS a, dst AS t, {_EDGE} FROM edges WHERE type = 'CALLS' "
        f"UNION ALL SELECT dst, src, {_EDGE} FROM edges WHERE type = 'CALLS' AND src <> dst",
        3,
    ),
)
def traverse_both(t: Tables) -> DataFrame:
    g = retail_graph(t).pin("CALLS")
    return paths.traverse(g, busiest(g, "src"), "CALLS", "both", 3)


@query(
    "semantic_trace",
    graph_sql(
        """SELECT p.src AS domain_id, p.dst AS feature_id, i.src AS function_id, d.dst AS file_id
        FROM edges i JOIN edges p ON p.type = 'PARENT_OF' AND p.dst = i.dst
        JOIN edges d ON d.type = 'DEFINED_IN' AND d.src = i.src WHERE i.type = 'IMPLEMENTS'"""
    ),
)
def semantic_trace(t: Tables) -> DataFrame:
    """Traced for every function at once."""
    g = retail_graph(t)
    return paths.semantic_trace(g, g.labelled("Function").select(F.col("id").alias("ref")))


@query(
    "neighbors",
    graph_sql(
        """SELECT name, type, via FROM (
          SELECT DISTINCT 0 AS k, g.name, 'Global' AS type, array_to_string(list_append(list_transform(
             list_filter(w.n, lambda x: x.id <> w.s), lambda x: x.name), g.name), '>') AS via
          FROM walk w JOIN edges u ON u.type = 'USES_GLOBAL' AND u.src = w.at JOIN nodes g ON g.id = u.dst
          UNION ALL SELECT DISTINCT 1, d.name, d.label, '' FROM caller c JOIN edges u ON u.src = c.id
          AND u.type IN ('CALLS', 'USES') JOIN nodes d ON d.id = u.dst)
        ORDER BY k, name, via, type LIMIT 1000""",
        CALLER,
        """walk AS (SELECT id AS s, id AS at, [{'id': id, 'name': name}] AS n, []::VARCHAR[] AS e FROM nodes WHERE id IN (FROM caller)
        UNION ALL SELECT w.s, c.dst, list_append(w.n, {'id': c.dst, 'name': f.name}), list_append(w.e, c.src || '>' || c.dst)
        FROM walk w JOIN calls c ON c.src = w.at JOIN fn f ON f.id = c.dst
        WHERE len(w.e) < 2 AND NOT list_contains(w.e, c.src || '>' || c.dst))""",
        recursive=True,
    ),
)
def neighbors(t: Tables) -> DataFrame:
    g = retail_graph(t).pin("CALLS")
    return paths.neighbors(g, busiest(g, "src"), depth=2, limit=1000)


@query(
    "callers",
    graph_sql("SELECT DISTINCT f.name AS caller FROM callee k JOIN calls c ON c.dst = k.id JOIN fn f ON f.id = c.src", CALLEE),
)
def callers(t: Tables) -> DataFrame:
    g = retail_graph(t).pin("CALLS")
    return neighborhood.callers(g, busiest(g, "dst"))


@query(
    "impact",
    graph_sql(
        """SELECT DISTINCT f.name AS caller, coalesce(f.is_volatile, false) AS is_volatile
        FROM up JOIN fn f ON f.id = up.id WHERE up.d > 0""",
        "seed AS (SELECT id FROM fn WHERE is_volatile)",
        "up AS (SELECT id, 0 AS d FROM seed UNION SELECT c.src, up.d + 1 FROM up JOIN calls c ON c.dst = up.id WHERE up.d < 3)",
        recursive=True,
    ),
)
def impact(t: Tables) -> DataFrame:
    """Callers within three calls of any volatile function."""
    g = retail_graph(t)
    volatile = g.labelled("Function").where("is_volatile").select(F.col("id").alias("ref"))
    return neighborhood.impact(g, volatile, 3)


@query(
    "globals",
    graph_sql(
        """SELECT g.name, g.file FROM fn f JOIN edges u ON u.src = f.id AND u.type = 'USES_GLOBAL'
        JOIN nodes g ON g.id = u.dst WHERE f.is_volatile"""
    ),
)
def globals_used(t: Tables) -> DataFrame:
    """Globals of every volatile function."""
    g = retail_graph(t)
    return neighborhood.globals_used(g, g.labelled("Function").where("is_volatile").select(F.col("id").alias("ref")))


@query(
    "seams",
    graph_sql(
        """SELECT f.name AS seam, f.file, (i.n * o.n)::DOUBLE AS risk, 'pinch-point' AS type FROM fn f
        JOIN (SELECT c.dst AS id, count(*) AS n FROM calls c JOIN fn x ON x.id = c.src
              WHERE NOT coalesce(x.is_volatile, false) GROUP BY 1) i ON i.id = f.id
        JOIN (SELECT c.src AS id, count(*) AS n FROM calls c JOIN fn x ON x.id = c.dst
              WHERE x.is_volatile GROUP BY 1) o ON o.id = f.id
        ORDER BY risk DESC, f.id LIMIT 20"""
    ),
)
def seams(t: Tables) -> DataFrame:
    return pinch.seams(retail_graph(t), ".*")


# ---- volatility and risk ---------------------------------------------------------------

_UP = "up AS (SELECT id, 0 AS hops FROM fn WHERE is_volatile UNION SELECT c.src, hops + 1 FROM up JOIN calls c ON c.dst = up.id WHERE hops < {})"


@query(
    "propagate_volatility",
    graph_sql("SELECT id, min(hops) AS hops FROM up GROUP BY id", _UP.format(60), recursive=True),
)
def propagate(t: Tables) -> DataFrame:
    return volatility.volatile_hops(retail_graph(t))


@query(
    "volatility_score",
    graph_sql(
        "SELECT f.id, round(CASE WHEN min(u.hops) IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (min(u.hops) + 1) END, 6) AS volatility_score "
        "FROM fn f LEFT JOIN up u ON u.id = f.id GROUP BY f.id",
        _UP.format(2),
        recursive=True,
    ),
)
def volatility_score(t: Tables) -> DataFrame:
    return volatility.volatility_scores(retail_graph(t)).select("id", F.round("volatility_score", 6).alias("volatility_score"))


@query("count_volatile", graph_sql("SELECT count(*) AS count FROM fn WHERE is_volatile"))
def count_volatile(t: Tables) -> DataFrame:
    return volatility.count_volatile(retail_graph(t))


RULES = [
    volatility.VolatilityRule("ui", "Brand#1.?", "file"),
    volatility.VolatilityRule("db", ".*gear.*", "function", "path"),
    volatility.VolatilityRule("io", ".*ECONOMY", "function", "content"),
    volatility.VolatilityRule("io", ".*", "unknown"),
]


@query(
    "seed_volatility",
    graph_sql(
        """SELECT id FROM fn WHERE regexp_full_match(file, 'Brand#[0-9]+') AND (regexp_full_match(file, 'Brand#1.?')
        OR regexp_full_match(name, '.*gear.*') OR regexp_full_match(content, '.*ECONOMY'))"""
    ),
)
def seed_volatility(t: Tables) -> DataFrame:
    seeded = volatility.seed_volatility(retail_graph(t), "Brand#[0-9]+", RULES)
    return seeded.labelled("Function").where("is_volatile").select("id")


def graph_with_history(t: Tables):
    g = retail_graph(t)
    return update_file_history(g, file_churn(touches(t)).withColumn("co_changes", F.array().cast("array<string>")))


_RISK = """raw AS (SELECT f.id, f.name, f.file, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(h.churn, 0) AS churn,
    coalesce(i.n, 0) * 0.4::DOUBLE + coalesce(o.n, 0) * 0.1::DOUBLE + coalesce(1.0::DOUBLE / (v.d + 1), 0) * 3.0::DOUBLE
    + coalesce(h.churn, 0) * 0.4::DOUBLE AS raw
    FROM fn f LEFT JOIN (SELECT dst AS id, count(*) AS n FROM calls GROUP BY 1) i ON i.id = f.id
    LEFT JOIN (SELECT src AS id, count(*) AS n FROM calls GROUP BY 1) o ON o.id = f.id
    LEFT JOIN (SELECT id, min(hops) AS d FROM up GROUP BY id) v ON v.id = f.id
    LEFT JOIN churn h ON h.file = f.file),
    risk AS (SELECT *, raw / (SELECT CASE WHEN max(raw) = 0 THEN 1.0 ELSE max(raw) END FROM raw) AS risk_score FROM raw)"""


@query(
    "risk_scores",
    graph_sql(
        "SELECT id, fan_in, fan_out, churn, round(risk_score, 6) AS risk_score FROM risk",
        TOUCH_SQL, CHURN_SQL, _UP.format(2), _RISK, recursive=True,
    ),
)
def risk_scores(t: Tables) -> DataFrame:
    scored = volatility.risk_scores(graph_with_history(t).pin("CALLS"))
    return scored.select("id", "fan_in", "fan_out", "churn", F.round("risk_score", 6).alias("risk_score"))


@query(
    "hotspots",
    graph_sql(
        """SELECT name, file, round(risk_score, 6) AS risk, churn FROM risk WHERE regexp_full_match(file, 'Brand#.*')
        ORDER BY risk_score * churn DESC, risk_score DESC, id LIMIT 20""",
        TOUCH_SQL, CHURN_SQL,
        "vol AS (SELECT id, 0 AS h FROM fn WHERE is_volatile UNION SELECT c.src, h + 1 FROM vol JOIN calls c ON c.dst = vol.id WHERE h < 60)",
        "up AS (SELECT id, 0 AS hops FROM vol UNION SELECT c.src, hops + 1 FROM up JOIN calls c ON c.dst = up.id WHERE hops < 2)",
        _RISK, recursive=True,
    ),
)
def hotspots(t: Tables) -> DataFrame:
    """The whole chain: history, propagation, scores, report."""
    g = volatility.propagate_volatility(graph_with_history(t).pin("CALLS"))
    found = pinch.hotspots(volatility.with_risk(g), "Brand#.*", check=False)
    return found.select("name", "file", F.round("risk", 6).alias("risk"), "churn")


# ---- what if ---------------------------------------------------------------------------

_TARGETS = "tgt AS (SELECT 'fn:' || p_partkey AS id FROM part WHERE p_size >= 46)"
_SEVERED = "severed AS (SELECT src, dst, type FROM edges WHERE (src IN (FROM tgt)) <> (dst IN (FROM tgt)))"


def _what_if(t: Tables, part: str) -> DataFrame:
    g = retail_graph(t)
    targets = t.part.where("p_size >= 46").select(F.concat(F.lit("fn:"), F.col("p_partkey").cast("string")).alias("id"))
    return whatif.what_if(g, targets)[part]


@query("what_if_severed", graph_sql("SELECT src AS source_id, dst AS target_id, type FROM severed", _TARGETS, _SEVERED))
def what_if_severed(t: Tables) -> DataFrame:
    return _what_if(t, "severed")


@query(
    "what_if_cross_boundary",
    graph_sql(
        "SELECT src AS source_id, dst AS target_id, 'CALLS' AS type FROM calls WHERE src NOT IN (FROM tgt) AND dst IN (FROM tgt)",
        _TARGETS,
    ),
)
def what_if_cross_boundary(t: Tables) -> DataFrame:
    return _what_if(t, "cross_boundary")


@query(
    "what_if_shared_state",
    graph_sql(
        """SELECT DISTINCT a.dst AS id, 'Global' AS label FROM edges a JOIN edges b ON a.dst = b.dst
        WHERE a.type = 'USES_GLOBAL' AND b.type = 'USES_GLOBAL' AND a.src IN (FROM tgt) AND b.src NOT IN (FROM tgt)""",
        _TARGETS,
    ),
)
def what_if_shared_state(t: Tables) -> DataFrame:
    return _what_if(t, "shared_state")


@query(
    "what_if_orphaned",
    graph_sql(
        """SELECT f.id, f.label FROM fn f WHERE f.id NOT IN (FROM tgt) AND f.id IN (SELECT dst FROM calls)
        AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = f.id AND c.src NOT IN (FROM tgt))""",
        _TARGETS,
    ),
)
def what_if_orphaned(t: Tables) -> DataFrame:
    return _what_if(t, "orphaned")


@query(
    "what_if_affected",
    graph_sql(
        "SELECT id, label FROM nodes WHERE id IN (SELECT src FROM severed UNION SELECT dst FROM severed)", _TARGETS, _SEVERED
    ),
)
def what_if_affected(t: Tables) -> DataFrame:
    return _what_if(t, "affected")


# ---- hierarchy -------------------------------------------------------------------------


@query(
    "overview",
    graph_sql("SELECT id, label FROM nodes WHERE label = 'Domain' OR (label = 'Feature' AND id NOT IN (SELECT dst FROM edges))"),
)
def overview(t: Tables) -> DataFrame:
    return structure.overview(retail_graph(t))


def _explore(part: str, feature: str):
    return lambda t: structure.explore_domain(retail_graph(t), feature)[part]


_SIBLINGS = """SELECT 'feat:' || n_nationkey AS id, 'Feature' AS label FROM nation
    WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) AND n_nationkey <> 7"""
query("explore_parent", "SELECT 'dom:' || n_regionkey AS id, 'Feature' AS label FROM nation WHERE n_nationkey = 7")(
    _explore("parent", "feat:7")
)
query("explore_children", "SELECT 'feat:' || n_nationkey AS id, 'Feature' AS label FROM nation WHERE n_regionkey = 2")(
    _explore("children", "dom:2")
)
query("explore_siblings", _SIBLINGS)(_explore("siblings", "feat:7"))
query(
    "explore_functions",
    graph_sql(
        """SELECT DISTINCT i.src AS id, 'Function' AS label FROM edges i JOIN edges p ON p.dst = i.dst AND p.type = 'PARENT_OF'
        WHERE i.type = 'IMPLEMENTS' AND p.src = 'dom:2'"""
    ),
)(_explore("functions", "dom:2"))


@query(
    "functions_under",
    graph_sql(
        """SELECT dst AS feature_id, src AS function_id FROM edges WHERE type = 'IMPLEMENTS'
        UNION SELECT p.src, i.src FROM edges i JOIN edges p ON p.dst = i.dst AND p.type = 'PARENT_OF' WHERE i.type = 'IMPLEMENTS'"""
    ),
)
def functions_under(t: Tables) -> DataFrame:
    return structure.functions_under(retail_graph(t))


@query("graph_stats", graph_sql("SELECT count(*) AS nodes FROM nodes"))
def graph_stats(t: Tables) -> DataFrame:
    return structure.graph_stats(retail_graph(t))


@query("graph_state", "SELECT 'order-' || max(o_orderkey) AS commit FROM orders")
def graph_state(t: Tables) -> DataFrame:
    """Stamped with the newest order, then read back."""
    newest = t.orders.agg(F.max("o_orderkey")).first()[0]
    return structure.graph_state(structure.update_graph_state(retail_graph(t), f"order-{newest}"))
