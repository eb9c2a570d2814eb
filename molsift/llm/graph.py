"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molsift.session import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node of ``edges`` (a, b long): node, root.

    Alternates large-star and small-star steps until nothing changes, which
    takes a logarithmic number of rounds. Minima are partial aggregates joined
    back to the edges, so a node of very many edges is never held in one group.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while (state := _state(now)) != before:
        before = state
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "cc")
        # Small star: smaller neighbours of a node, and itself, move to its smallest one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).filter("a <> b").distinct()
        now = materialise(small, "cc")
    tops = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tops).distinct()
