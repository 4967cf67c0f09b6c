"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b); nodes that are their own root are left out.

    Each round hangs the larger neighbours of every node to the smallest one, then the smaller ones of every node to their smallest. Chains
    of any length close in logarithmically many rounds; each is written to the shared folder. It ends when the links no longer change.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < n").select(F.col("n").alias("a"), F.col("m").alias("b"))
        star = staged(large.union(own).where("a <> b").distinct())
        least = star.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = star.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        old, new = (e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for e in (edges, after))
        edges = after
        if tuple(old) == tuple(new):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
