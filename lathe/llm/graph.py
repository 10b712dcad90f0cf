"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import dropped, staged


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links(a, b) -> (node, root): root is the smallest node that node reaches. Only nodes with a link appear.

    Each round is two aggregations by node whose minimum is combined before the shuffle, and two joins that adaptive execution
    can split, so a node with many links is no hot task. Rounds are logarithmic in the number of nodes; each is staged in the
    shared folder, and lost executors repeat one round at most.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    total = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour of a links to the least of a's neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        before, edges = edges, staged(small.distinct(), "links")
        # A fixed point has a star of each component: no root is itself a child. Both are sets, so equal numbers and none new say equal.
        now = edges.count()
        if now == total and edges.join(before, ["a", "b"], "left_anti").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        dropped(before)
        total = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
