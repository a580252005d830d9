"""Comparing importances across rows and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrows.spec import ID


def rank_features(attribution: DataFrame, by: str = ID) -> DataFrame:
    """Add `rank` from 1: features of each row (or run) by importance."""
    order = Window.partitionBy(by).orderBy(F.desc("importance"), "feature")
    return attribution.withColumn("rank", F.row_number().over(order))


def log_rank(per_run: DataFrame) -> DataFrame:
    """(feature, score): sum over runs of 1 - ln(rank) / ln(p), only where importance > 0."""
    runs = Window.partitionBy("run")
    gain = F.when(
        F.col("importance") > 0, 1 - F.ln("rank") / F.ln(F.count("*").over(runs))
    ).otherwise(F.lit(0.0))
    ranked = rank_features(per_run, "run").withColumn("gain", gain)
    return ranked.groupBy("feature").agg(F.sum("gain").alias("score"))


def rank_share(attribution: DataFrame) -> DataFrame:
    """(rank, feature, share): how often a feature holds a rank."""
    counts = rank_features(attribution).groupBy("rank", "feature").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("rank"))
    return counts.select("rank", "feature", share.alias("share"))
