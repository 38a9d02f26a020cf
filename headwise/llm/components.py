"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.session import materialise, scratch_path


#: Parts that the rows of every node are dealt to when they meet its smallest neighbour.
SALTS = 16


def _with_least(rows: DataFrame) -> DataFrame:
    """`rows` (src, dst) with `least`, the smallest dst of their src.

    The smallest comes from a map-side combined aggregate. It is repeated for every part, and the rows of a node
    meet it in 16 parts by their dst, so that a node with very many neighbours is not one task's work.
    """
    least = rows.groupBy("src").agg(F.min("dst").alias("least"))
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
    return dealt.join(parts, ["src", "part"]).select("src", "dst", "least")


def _adopted(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is joined to that node's smallest neighbour instead."""
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _with_least(both).where("dst > src").select(F.col("dst").alias("src"), F.least("least", "src").alias("dst"))


def _gathered(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are joined to the smallest of them."""
    joined = _with_least(edges).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    least = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    return joined.unionAll(least).where("src > dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected graph; root is the smallest node it reaches.

    `edges` has longs `src` and `dst`. Star contraction: every round replaces edges by
    edges to smaller nodes, in a number of rounds that grows with the logarithm of the
    longest path. Every round is written to the shared folder, so a lost executor costs one
    round at most. A node with very many neighbours is spread over all tasks (`_with_least`). No edges give
    no rows; loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "components")
    down = edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    current = materialise(down.distinct(), f"{folder}/0")
    before, step = None, 0
    while True:
        state = current.agg(
            F.count("*").alias("n"), F.expr("sum(xxhash64(src, dst) % 1000000007L)").alias("digest")
        ).first()
        if state == before or not state["n"]:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionAll(
                current.select(F.col("dst").alias("node"), F.col("dst").alias("root"))
            ).distinct()
        before, step = state, step + 1
        current = materialise(_gathered(_adopted(current)), f"{folder}/{step}")
