"""Connected components over an edge table, in alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import discard, stored


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour larger than u is tied to the least of u and its neighbours; and the table that this reads."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")  # a table of its own, so that Spark can split a hub's edges
    return (
        both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b").distinct()
    ), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u and its smaller neighbours are tied to the least of those neighbours; and the table that this reads."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), least


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars already: a node tied to a lesser one has one edge and none is tied to it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node reachable.

    Each round is written to the shared folder, so that a lost executor costs
    one round; tables of earlier rounds are deleted. Edges that are stars take
    no round. Node values need an order; loops and repeats are harmless.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large, least = _large_star(now)
        large = stored(large, "large-stars")  # two reads of it in the small step
        discard(now, least)
        small, least = _small_star(large)
        now = stored(small, "stars")
        discard(large, least)
    raise RuntimeError("components did not settle")
