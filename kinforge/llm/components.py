"""Connected components by hooking to the smallest neighbour and contracting.

Every round each node hooks to the smallest of its neighbours and itself, follows one more step, and the edges are drawn
again between the hooks. Only local minima survive a round, so the number of nodes that still have edges halves at
least; rounds grow with the logarithm of the longest chain. Hooks come from partial minima, so a node with very many
edges doesn't meet in one task, and edges are never collected. Hooks go to the other tables by broadcast while they are
few enough (``runtime.small``), so that a root of very many nodes isn't one key of a shuffle; beyond that they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.runtime import settle, small


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of the edges the smallest node it is connected with. Loops and repeated edges are allowed."""
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    ends = settle(ends)
    labels = settle(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn("root", F.col("node")))
    while not ends.isEmpty():
        hooks = ends.select(F.col("b").alias("node"), F.col("a").alias("to")).union(ends.select("a", "a")).union(ends.select("a", "b")).groupBy("node").agg(F.min("to").alias("to"))
        hooks = settle(hooks.select("node", F.least("node", "to").alias("to")))
        onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hooks = small(settle(hooks.join(small(onward), "to").select("node", F.col("next").alias("to"))))
        labels = settle(labels.join(hooks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        of_a, of_b = hooks.select(F.col("node").alias("a"), F.col("to").alias("x")), hooks.select(F.col("node").alias("b"), F.col("to").alias("y"))
        drawn = ends.join(of_a, "a").join(of_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        ends = settle(drawn.filter("a < b").distinct())
    return labels
