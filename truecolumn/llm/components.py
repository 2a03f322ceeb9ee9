"""Connected components of a link table, as a series of Spark jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import stored


def _edges(u: Column, v: Column) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _named(edges: DataFrame) -> DataFrame:
    """The edges with the new names ``nu`` and ``nv`` of their ends, stored."""
    both = edges.selectExpr("inline(array(struct(u AS node, v AS other), struct(v AS node, u AS other)))")
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("name"))
    beyond = least.select(F.col("node").alias("name"), F.col("name").alias("beyond"))
    names = least.join(beyond, "name").select("node", F.col("beyond").alias("name"))
    one = names.withColumnsRenamed({"node": "u", "name": "nu"})
    two = names.withColumnsRenamed({"node": "v", "name": "nv"})
    return stored(edges.join(one, "u").join(two, "v").select("u", "v", "nu", "nv"), "links")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; the component is its smallest node.

    ``known`` is an earlier result, stored: its nodes are in the result too, as if
    its links were among ``links``, and only what joins its components is worked on.

    Every round each node takes the name of its smallest neighbour's smallest
    neighbour, and the graph shrinks to the new names, until no link is left.
    A round is one stored step.  A node with very many links is reduced by partial
    aggregation and its join is one that adaptive execution splits.  Null ends and
    loops link nothing.
    """
    links = links.where("u <> v").select("u", "v")
    if known is not None:
        for end in ("u", "v"):
            own = known.withColumnsRenamed({"node": end, "component": "name"})
            links = links.join(own, end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    rounds = []
    rest = links.where("u <> v").select(*_edges(F.col("u"), F.col("v")))
    while True:
        step = _named(rest.distinct())
        rest = step.where("nu <> nv").select(*_edges(F.col("nu"), F.col("nv")))
        rounds.append(step)
        if rest.isEmpty():
            break
    if len(rounds) == 1 and known is not None and rounds[0].isEmpty():
        return known
    steps = [step.selectExpr("inline(array(struct(u AS node, nu AS name), struct(v AS node, nv AS name)))").distinct() for step in rounds]
    if known is None:
        found = steps.pop(0).withColumnRenamed("name", "component")
    else:
        # A component's name is one of its nodes, so what is not known yet is a component of its own.
        found = known.select("node", "component").union(steps[0].select("node", F.col("node").alias("component"))).distinct()
    for names in steps:
        step = names.withColumnsRenamed({"node": "component", "name": "next"})
        found = found.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return stored(found, "components")
