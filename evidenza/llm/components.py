"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenza.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node of its closed neighbourhood to its larger neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and to itself; edges point from larger to smaller."""
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    hung = edges.join(least, F.col("a") == F.col("n")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has a link to another node; component is the smallest node of it.

    Null ends and links of a node to itself are no links; repeated and reversed links count once; an empty table gives
    an empty result. Nodes may be of any orderable type, strings compare by code points. The per-node minimum is
    aggregated before the shuffle, each round is checkpointed, and the rounds end once the stars stand still.
    """
    x, y = F.col(a), F.col(b)
    edges = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    edges = cut(edges)
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
