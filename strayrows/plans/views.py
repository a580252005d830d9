"""Input views of the example tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.sources.tables import read_parquet
from strayrows.spec import FeatureSpec
from strayrows.staging import stage

ORDER_NUMERIC = ("o_totalprice", "n_lines", "qty", "max_price", "max_disc")
ORDER_CATEGORICAL = ("o_orderstatus", "o_orderpriority")
ORDER_SPEC = FeatureSpec(ORDER_NUMERIC + ORDER_CATEGORICAL, frozenset(ORDER_CATEGORICAL))
ORDER_NUMERIC_SPEC = FeatureSpec(ORDER_NUMERIC, frozenset())

_shared: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A staged intermediate that several queries of one session read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = stage(build(), name)
    return _shared[key]


def forget_shared() -> None:
    _shared.clear()


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: totals of its lines, status and priority."""
    lines = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.max("l_extendedprice").alias("max_price"),
            F.max("l_discount").alias("max_disc"),
        )
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(
        F.col("o_orderkey").alias("row_id"), *ORDER_NUMERIC, *ORDER_CATEGORICAL
    )


def staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism
    return shared(
        spark, sf_dir, "order-features",
        lambda: order_features(spark, sf_dir).repartition(cores),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x, cluster_id)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("int").alias("cluster_id"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, score = length, label = toxic)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("toxic").cast("int").alias("label"),
        F.col("quality").cast("int").alias("quality"),
    )
