"""Connected components by contraction, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .data import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; nodes are joined exactly when a path of links joins them.

    Each round every node moves to that of itself and its neighbours with the smallest hash, drawn anew each round,
    and links between moved nodes remain. A constant share of the nodes is expected to go in each round, whatever the
    shape of the graph, and hubs are handled by a minimum that is combined before the shuffle. Every round is written,
    so that lost executors cost one round at most.
    """
    edges = store(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    roots = store(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        draw = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))
        least = both.groupBy("a").agg(F.min(draw("b")).alias("m"))
        moved = store(least.select(F.col("a").alias("v"), F.least(F.col("m"), draw("a"))["v"].alias("to")))
        roots = store(roots.join(moved, roots.root == moved.v, "left").select("node", F.coalesce("to", "root").alias("root")))
        left = edges.join(moved.withColumnRenamed("v", "a").withColumnRenamed("to", "na"), "a")
        edges = store(left.join(moved.withColumnRenamed("v", "b").withColumnRenamed("to", "nb"), "b")
                      .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct())
    return roots
