"""Lookup joins that stay safe on skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.spec import quote
from strayrows.staging import stage

#: What a broadcast may weigh, as text; above, the table is shuffled.
BROADCAST_BYTES = 64 * 1024 * 1024
#: A key with more than this share of the rows is spread.
HOT_SHARE = 1 / 64


def size_of(df: DataFrame) -> int:
    """Bytes of all values written as text, in one pass over a small staged table."""
    texts = F.length(F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns])))
    return df.agg(F.coalesce(F.sum(texts), F.lit(0))).first()[0]


def lookup(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a lookup table with unique keys; `small` should be staged.

    A table of at most BROADCAST_BYTES (measured, not assumed) is broadcast. Beyond that, the keys
    that hold more than HOT_SHARE of the rows of `df`, 64 at most, are met by a broadcast of their
    rows, and only the others are shuffled, so no task gets more than such a share.
    """
    if size_of(small) <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), list(on), how)
    keys = [F.col(quote(c)) for c in on]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(stage(counts.where(F.col("_n") > F.lit(HOT_SHARE * total)).drop("_n"), "hot-keys"))
    spread = df.join(hot, list(on), "left_semi").join(F.broadcast(small.join(hot, list(on), "left_semi")), list(on), how)
    return spread.unionByName(df.join(hot, list(on), "left_anti").join(small, list(on), how))
