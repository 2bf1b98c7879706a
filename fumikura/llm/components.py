"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation: neighbours of a node move to its least neighbour.

    ``larger`` moves the neighbours above the node, else the node itself and those below it.
    """
    if larger:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    joined = both.join(least, "a")
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """<node, root> of every node with an edge; ``root`` is the least node of its component.

    ``edges`` is <a, b> of BIGINT.  Large-star and small-star steps alternate
    until nothing moves, a logarithmic number of rounds; each round is written
    to the shared folder.  Minima are taken before the shuffle and no node's
    neighbours are gathered in one place, so hubs do no harm.
    """
    now = stored(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = stored(_star(_star(now, larger=True), larger=False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
