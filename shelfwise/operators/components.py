"""Connected components of an undirected graph given as an edge frame.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond"): each round points neighbours at the smallest node seen, and the rounds grow with the
logarithm of a component's diameter.  Every round is a grouped minimum with partial aggregation and
a join back, and is cut from its lineage by the shared checkpoint folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import settled

#: Far above what the logarithm of any real diameter needs; a graph that exceeds it is reported.
MAX_ROUNDS = 64


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(arcs)
    return arcs.join(least, arcs["u"] == least["node"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(arcs)
    to_least = arcs.join(least, arcs["u"] == least["node"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("node").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(own).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node of its component.

    `edges` has columns u and v of one ordered type.  Loops, repeated edges and nulls are ignored;
    without edges the result is empty.
    """
    edges = settled(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        edges = settled(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    pointed = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pointed.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
