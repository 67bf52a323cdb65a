"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Parts into which the neighbours of one node are dealt (a component's centre may have very many): so many at least, and as many as give each part this many of all edges.
SALTS, PART_EDGES = 32, 1_000_000


def _with_least(edges: DataFrame, least, salts: int) -> DataFrame:
    """``edges`` (a, b) with m: the result of ``least`` (of the smallest b of a) for each a.

    The edges of a node are dealt over salts by their other end. A salt's minimum is taken
    first; the minima of a node (one for each salt at most) then settle its m and bring it
    back to each salt, so no task gets all edges of one node.
    """
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("a", "salt").agg(F.min("b").alias("low"))
    settled = parts.select("a", "salt", least(F.min("low").over(Window.partitionBy("a"))).alias("m"))
    return dealt.join(settled, ["a", "salt"]).select("a", "b", "m")


def connected_components(edges: DataFrame, salts: int | None = None) -> DataFrame:
    """node, component (its smallest member) of every node of ``edges`` (a, b).

    Alternating large-star and small-star rounds: each replaces edges by edges to the
    smallest neighbour, which keeps the components and ends in stars after a number of rounds
    that grows with the logarithm of the longest path. Counts and a digest of the edge list
    tell when it is stable; nothing but these reaches the driver. Edges with a null end and
    loops are ignored; without edges the result is empty.
    """
    edges = checkpointed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    salts = salts or max(SALTS, edges.count() // PART_EDGES)
    before = None
    while True:
        # large star: neighbours above a node link to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, lambda low: F.least(low, F.col("a")), salts)
        edges = large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        small = _with_least(edges, lambda low: low, salts)
        edges = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = checkpointed(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
