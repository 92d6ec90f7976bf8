"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.llm.common import saved


def _to_least(edges: DataFrame) -> DataFrame:
    """Every neighbour v of u gets u's least neighbour (or u) as its new neighbour.

    """
    least = _least(edges)
    out = edges.join(least, "u").select("v", "m").union(least)
    return out.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours, pre-aggregated.

    It is saved, so that the join on u has an exchange of its own on either side: only
    then does Spark split the rows of a hub.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return saved(least.select("u", F.least("u", "m").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(a, b) of longs -> (node, root): every node that has a link to another, and the least
    node that it can reach.  Repeated links, links in both directions and to itself are fine.

    Large-star links the greater neighbours of each node to its least neighbour, small-star the
    smaller ones; the rounds end when the table, told by a count and a sum of hashes, stays
    the same.  Only these two numbers reach the driver; each round is checkpointed.
    """
    edges = saved(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .filter("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        edges = saved(_to_least(large))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.union(roots)
