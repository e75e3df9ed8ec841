"""Connected components of an undirected graph given as pairs of 64-bit nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``): the root is the least
    node of the component.

    Alternating stars: a large star hangs each node's greater neighbours on its
    least neighbour, a small star does so with the lesser ones; the pairs become
    one star per component in a number of rounds that grows with the logarithm
    of the path length. What a round joins is written first, so both sides are
    plain scans and the links of a hot node can be split. Each round is written, so a lost executor repeats one
    round at most; nothing but a checksum comes to the driver.
    """
    # a > b throughout: each node hangs on a lesser one
    hung = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = hung.select("a", "b").unionByName(hung.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")))
        # every lesser neighbour of a, and a itself, hangs on the least of them
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lower.select("a", F.col("m").alias("b"))
        )
        hung = written(small.where("a <> b").distinct())
        now = hung.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return hung.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        hung.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
