"""Connected components of a graph given by its edges, by alternating stars.

Each round points every node's larger neighbours, then its smaller ones, at the smallest node it
sees; the number of rounds grows with the logarithm of the longest path.  A hub's neighbours are
reduced by a partial minimum before the shuffle, and joined back by a join that adaptive execution
splits.  The joins are merge joins by hint: both sides grow with the graph, and a broadcast passes
through the driver, a hashed copy of every round's nodes many times their size in a shuffle.  Every round is written to shared storage, so that a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanescope.llm.shared import written


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _nearest(both).withColumn("least", F.least("a", "least"))
    return (
        both.join(least.hint("merge"), "a").where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where(F.col("b") < F.col("a"))
    least = _nearest(down)
    moved = down.join(least.hint("merge"), "a").where(F.col("b") > F.col("least")).select(
        F.col("b").alias("a"), F.col("least").alias("b")
    )
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of comparable nodes to (node, component), the smallest node reachable.

    Components themselves, and nodes without edges, are not listed; loops and repeated edges do
    no harm.  No edges give an empty table.
    """
    edges = written(edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where(F.col("a") > F.col("b")).distinct())
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges).distinct()).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
