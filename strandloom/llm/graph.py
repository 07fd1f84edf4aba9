"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, spread_join

#: Rounds halve the depth of every tree at least, so this covers any graph that fits a cluster.
MAX_ROUNDS = 60


def _least(edges: DataFrame, value) -> DataFrame:
    return edges.groupBy("a").agg(value.alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = _least(both, F.least(F.min("b"), F.col("a")))
    return spread_join(both, least, "a", "n", F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges, F.min("b"))
    pointed = spread_join(edges, least, "a", "n", F.col("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.union(least.select("a", "m").toDF("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates the large-star and the small-star operation (Kiveris et al., 2014) until the
    edges are stars. Self loops and repeated edges are allowed; an empty table gives an empty one.
    A star's centre may have any share of all edges: its joins are dealt over tasks.
    """
    a, b = edges.columns
    stars = cut(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        before = stars
        wide = cut(_large_star(before).distinct())
        stars = cut(_small_star(wide).distinct())
        release(before, wide)
        now = stars.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == seen or not now["n"]:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)
