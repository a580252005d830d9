"""Tables behind the usual views of outliers and their clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrows.operators.prep import encode, flag_outliers, limits
from strayrows.spec import ID, FeatureSpec, quote


def scatter(embedding: DataFrame, scores: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(row_id, x, y, score, cluster_id) at one k."""
    at_k = clusters.where(F.col("k") == k).select(ID, "cluster_id")
    return embedding.join(scores.select(ID, "score"), ID).join(at_k, ID)


def normal_and_cluster(
    flagged: DataFrame, clusters: DataFrame, k: int, cluster_id: int
) -> DataFrame:
    """All normal rows and the outliers of one cluster; needs the anomaly flag."""
    chosen = clusters.where((F.col("k") == k) & (F.col("cluster_id") == cluster_id)).select(ID)
    outliers = flagged.where(F.col("anomaly") == 1).join(chosen, ID, "left_semi")
    return flagged.where(F.col("anomaly") == 0).unionByName(outliers)


def bucket(column: Column, lo: float, hi: float, n: int) -> Column:
    """Equal-width bucket 0..n-1; the upper end belongs to the last one."""
    if hi == lo:
        return F.when(column.isNotNull(), F.lit(0))
    at = F.floor((column - F.lit(lo)) / F.lit((hi - lo) / n))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("int")


def histogram(df: DataFrame, feature: str, by: str, n: int = 50) -> DataFrame:
    """(bucket, lo, hi, <by>, n) counts of a numeric feature per class."""
    lo, hi = limits(df, [feature])[feature]
    width = (hi - lo) / n
    b = bucket(F.col(quote(feature)).cast("double"), lo, hi, n)
    counts = df.groupBy(b.alias("bucket"), quote(by)).agg(F.count("*").alias("n"))
    return counts.select(
        "bucket",
        (F.lit(lo) + F.col("bucket") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bucket") + 1) * F.lit(width)).alias("hi"),
        quote(by),
        "n",
    )


def category_histogram(df: DataFrame, feature: str, by: str) -> DataFrame:
    """(value, <by>, n) counts of a category per class."""
    value = F.col(quote(feature)).cast("string").alias("value")
    return df.groupBy(value, quote(by)).agg(F.count("*").alias("n"))


def density_2d(df: DataFrame, fx: str, fy: str, n: int = 20) -> DataFrame:
    """(bx, by, n): joint histogram of two numeric features."""
    bounds = limits(df, [fx, fy])
    bx = bucket(F.col(quote(fx)).cast("double"), *bounds[fx], n)
    by = bucket(F.col(quote(fy)).cast("double"), *bounds[fy], n)
    return df.groupBy(bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("n"))


def parallel_view(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Rows with categories as codes, all features on numeric axes."""
    encoded, _ = encode(df, spec.categories)
    return encoded


def axis_ticks(df: DataFrame, features: Sequence[str], n: int = 5) -> DataFrame:
    """(feature, position, tick): n even steps from min to max of each numeric feature."""
    ends = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.min(F.col(quote(f)).cast("double")).alias("lo"),
                    F.max(F.col(quote(f)).cast("double")).alias("hi"),
                )
                for f in features
            ]
        ).alias("e")
    ).select(F.inline("e"))
    steps = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("position"))
    tick = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("position") / F.lit(n - 1)
    return steps.select("feature", "position", tick.alias("tick"))


def exploration_table(df: DataFrame, outliers: DataFrame) -> DataFrame:
    """Features with the anomaly flag."""
    return flag_outliers(df, outliers)
