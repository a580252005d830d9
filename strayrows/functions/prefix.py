"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrows.staging import stage


def running_totals(
    df: DataFrame, order: Column, values: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Add `cum_<v>` (inclusive) for each value column, in the given unique order.

    Rows are range-partitioned by the order; each range gets its own window and
    the totals of the ranges before it, one small row per range, are added.
    """
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        df.repartitionByRange(partitions, order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    per_range = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: the window and the broadcast hold `partitions` rows at most.
    offsets = per_range.select(
        "_range",
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    within = (
        Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .select(
            *[c for c in df.columns],
            *[(F.sum(v).over(within) + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values],
        )
    )
