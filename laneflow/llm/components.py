"""Connected components of an edge table, by alternating large and small stars.

Every round joins and aggregates the edges once for each star and writes them to the shared folder,
so a lost executor costs one round at most. No list of neighbours is ever collected: a node of a
million links is one row of an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from laneflow.llm import shared
from laneflow.llm.shared import F


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node to its least neighbour."""
    forth = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        links = forth.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        links = forth.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that each node of an edge ``a, b`` reaches, if it isn't the node."""
    edges = shared.materialize(edges.filter("a <> b").select("a", "b").distinct(), "components")
    before = None
    while (now := _signature(edges)) != before and now[0]:
        before = now
        edges = shared.materialize(_star(_star(edges, large=True), large=False), "components")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
