"""Graphs as tables of edges (src, dst): reachability by frontier joins, dominators, ancestors, topological depth.

Each round joins the frontier with the edges and is cut by a checkpoint, so plans stay short and lost executors repeat one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.plans.folders import cut


def bfs(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """roots(node) -> (node, depth) of all that can be reached."""
    seen = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, rounds + 1):
        front = cut(front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise RuntimeError(f"more than {rounds} rounds")


def ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes from which the given ones can be reached."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bfs(back, nodes).where("depth > 0").select("node")


def depths(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Longest path to each node of an acyclic graph."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now = cut(nodes.withColumn("depth", F.lit(0)))
    for _ in range(rounds):
        step = edges.join(now, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg((F.max("depth") + 1).alias("d"))
        new = cut(now.join(step, "node", "left").select("node", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "depth")
        now = new.select("node", "depth")
    raise RuntimeError("the graph has a cycle, or paths are too long")


def dominator_paths(edges: DataFrame, root, rounds: int = 1000) -> DataFrame:
    """(node, path): the dominators of each node that root reaches, from root to the node itself. One row for each node.

    Starts from paths of a breadth-first tree. In each round a node's path becomes what all its reached predecessors' paths begin
    with, and the node: the common beginning of many lists is that of the least and the greatest, which are aggregated.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    now = cut(spark.createDataFrame([(root,)], f"node {kind}").select("node", F.array("node").alias("path")))
    front = now
    for _ in range(rounds):
        step = front.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("path").alias("p"))
        front = cut(step.join(now, F.col("dst") == F.col("node"), "left_anti").select(F.col("dst").alias("node"), F.concat("p", F.array("dst")).alias("path")))
        if front.isEmpty():
            break
        now = cut(now.unionByName(front))
    else:
        raise RuntimeError(f"more than {rounds} rounds")
    known = now.select("node")
    inner = cut(edges.join(known.withColumnRenamed("node", "src"), "src").join(known.withColumnRenamed("node", "dst"), "dst").where((F.col("src") != F.col("dst")) & (F.col("dst") != F.lit(root))).select("src", "dst").distinct())
    for _ in range(rounds):
        ends = inner.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("path").alias("a"), F.max("path").alias("b"))
        same = F.aggregate(F.arrays_zip("a", "b"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x["a"].eqNullSafe(x["b"]), 1).otherwise(0)).alias("n"), (s["on"] & x["a"].eqNullSafe(x["b"])).alias("on")))["n"]
        new = ends.select(F.col("dst").alias("node"), F.concat(F.slice("a", F.lit(1), same), F.array("dst")).alias("new"))
        after = cut(now.join(new, "node", "left").select("node", F.coalesce("new", "path").alias("path"), (F.col("new").isNotNull() & (F.col("new") != F.col("path"))).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("node", "path")
        now = after.select("node", "path")
    raise RuntimeError(f"more than {rounds} rounds")


def dominators(edges: DataFrame, root) -> DataFrame:
    """(node, dominator) for all dominators of each node that root reaches, itself included."""
    return dominator_paths(edges, root).select("node", F.explode("path").alias("dominator"))


def dominator_tree(edges: DataFrame, root) -> DataFrame:
    """(node, parent): the immediate dominator of each node but root."""
    return dominator_paths(edges, root).where(F.size("path") > 1).select("node", F.element_at("path", -2).alias("parent"))


def dfs(edges: DataFrame, root, children: str = "dst") -> DataFrame:
    """(node, parent, path, place): the preorder of a depth-first walk of the tree or forest below root, children by their order. A node
    that can be reached in several ways keeps the first of them in that order. For graphs without cycles; paths of ranks are compared."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    ranked = edges.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(children)))
    now = front = cut(spark.createDataFrame([(root,)], f"node {kind}").select("node", F.lit(None).cast(kind).alias("parent"), F.array(F.lit(0)).alias("path")))
    for _ in range(1000):
        step = front.join(ranked, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.concat("path", F.array("rank")).alias("path"))
        front = cut(step.groupBy("node").agg(F.min(F.struct("path", "parent")).alias("m")).select("node", "m.parent", "m.path"))
        if front.isEmpty():
            found = now.groupBy("node").agg(F.min(F.struct("path", "parent")).alias("m")).select("node", "m.parent", "m.path")
            from lathe.operators.lists import with_position

            return with_position(found, ["path"], "place")
        now = cut(now.unionByName(front))
    raise RuntimeError("the graph has a cycle, or paths are too long")
