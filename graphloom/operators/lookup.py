"""Finding nodes by id, qualified name or name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph

def _named(refs: str | list[str]) -> Column:
    wanted = [refs] if isinstance(refs, str) else list(refs)
    return F.col("id").isin(wanted) | F.col("fqn").isin(wanted) | F.col("name").isin(wanted)


def resolve_ids(graph: PropertyGraph, refs) -> DataFrame:
    """Ids of the nodes whose id, fqn or name equals a reference.

    ``refs`` is a string, a list of strings or a DataFrame with a ``ref`` column. The
    DataFrame form is one equi-join on the exploded keys of a node; a join on a
    disjunction would be a nested loop.
    """
    if isinstance(refs, DataFrame):
        keys = graph.nodes.select("id", F.explode(F.array("id", "fqn", "name")).alias("ref"))
        return keys.join(refs.select("ref"), "ref", "left_semi").select("id").distinct()
    return graph.nodes.where(_named(refs)).select("id")


def resolve(graph: PropertyGraph, refs) -> DataFrame:
    """The nodes themselves."""
    if isinstance(refs, DataFrame):
        return graph.nodes.join(resolve_ids(graph, refs), "id", "left_semi")
    return graph.nodes.where(_named(refs))


def resolve_one(graph: PropertyGraph, refs) -> DataFrame:
    """The id of the hit with the lowest id."""
    return resolve_ids(graph, refs).orderBy("id").limit(1)
