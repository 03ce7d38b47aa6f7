"""Connected components of a graph too large for one machine: alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, skew_join


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (u, v): root is the smallest node that it is connected with.

    Each round is two aggregates and two joins on nodes and runs until a round changes nothing; the number of rounds grows with the
    logarithm of a component's size. A node with very many edges (the smallest of a large component) is joined by broadcast, so that
    no task gets all its rows. Edges of a node to itself are kept as single nodes. Nulls must not occur; no rows give no rows.
    """
    stars = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = stars.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    stars = stars.filter("u <> v")
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = durable(skew_join(both, least, "u", 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = skew_join(large, least, "u", 2 * mark[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        stars = durable(small)
        now = _mark(stars)
        if now == mark:
            break
        mark = now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    linked = roots.select("node").unionByName(roots.select(F.col("root").alias("node"))).distinct()
    alone = nodes.join(linked, "node", "left_anti")
    return durable(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).unionByName(alone))
