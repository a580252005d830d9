"""Connected components of a graph given as edges, by alternating star contractions.

Each round points nodes at the smallest node they see (large stars, then small stars), which takes a
number of rounds logarithmic in the length of paths; no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node of its component.

    Self loops and repeated edges are allowed; nulls are not.
    """
    now = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stage(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-stars"
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(pairs.select("a", F.col("m").alias("b")))
        now = stage(small.where("a <> b").distinct(), "small-stars")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Two numbers that change with the set of edges."""
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )
