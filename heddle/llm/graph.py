"""Connected components of an edge table, by alternating star operations.

Large star links every larger neighbour of a node to the least of its
neighbourhood, small star every smaller one; both keep components and shorten
paths, so after about log(path length) rounds each node hangs on the least node
of its component.  A round is two grouped minima (combined before the shuffle)
and two joins on the node; a node with very many edges is split by AQE.  Every
round is a checkpoint; one grouped count tells whether another is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import cut


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    if larger:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = edges.join(least, F.col("a") == F.col("node"))
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every edge (a, b) hangs a node on a root: no a has two edges, and no b is an a."""
    end = lambda c, up: F.struct(F.col(c).alias("x"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e"))
    counts = ends.select("e.*").groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs to (node, root): every node of an edge that is not its component's least, with that least."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while not settled(edges):
        edges = cut(_star(_star(edges, larger=True), larger=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
