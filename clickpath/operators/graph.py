"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each round is a map-side combined ``min`` per node and a join of the edges with it, so
a hub costs its edges once (adaptive execution splits its join partition) and no node's
neighbours are ever gathered in one place.  Paths shrink geometrically: a chain of n
nodes takes O(log n) rounds.  Rounds go through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, stored

MOST_ROUNDS = 100


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, and it itself if that is less."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select(
        F.col("u").alias("node"), F.least("least", "u").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    j = both.join(_least(both), both.u == F.col("node")).where(F.col("v") > F.col("u"))
    return j.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = _least(edges)
    j = edges.join(least, edges.u == F.col("node")).where(F.col("v") > F.col("least"))
    return j.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
        least.select(F.col("node").alias("u"), F.col("least").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, component) of every node of the undirected edges: the component is the
    least node of it.

    Loops name a node that may have no other edge (it is its own component); rows with a
    null end are no edges; repeated edges count once.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = e.where(F.col("a") == F.col("b")).select("a").distinct()
    star, place = stored(e.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    for _ in range(most_rounds):
        new, new_place = stored(_small_star(_large_star(star)), "components")
        # equal sets of edges: their number and the sum of their hashes
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(spark, place)
        star, place = new, new_place
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    found = star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
    lone = alone.join(found, F.col("a") == F.col("node"), "left_anti")
    return found.union(lone.select(F.col("a").alias("node"), F.col("a").alias("component")))
