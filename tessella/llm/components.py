"""Connected components by alternating large-star and small-star steps.

Edges stay in DataFrames throughout; each step is a minimum per node and a join
back, so a node with very many edges is pre-aggregated and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of its neighbours and itself."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = edges.select(ends.alias("e")).select("e.a", "e.b")
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    ends = F.explode(F.array("a", "b"))
    return edges.join(low, "a").select(ends.alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows (a, b) of node ids to rows (node, component) for all nodes but the smallest of each component.

    rounds: stop after so many steps; nodes with one label are then connected,
    but a component may still have several labels.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), slim=True)
    mark, done = None, 0
    while True:
        wide = stored(_large_star(now), slim=True)
        after = stored(_small_star(wide), slim=True)
        dropped(now, wide)
        now, done = after, done + 1
        if rounds and done == rounds:
            low = now.groupBy("a").agg(F.min("b").alias("component"))
            return low.select(F.col("a").alias("node"), "component")
        # stable once every node points at a root: no node that is pointed at points on
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(row)
