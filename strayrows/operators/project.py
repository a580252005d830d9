"""Feature vectors: plain, or hashed onto a fixed number of random projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrows.functions.tokens import feature_weights, projection_weights
from strayrows.spec import ID, FeatureSpec, quote, split_roles


def plain_vector(spec: FeatureSpec) -> Column:
    """The numeric features as array<double>; needs encoded categories."""
    if spec.categories:
        raise ValueError(f"encode or project the categories {spec.categories} first")
    return F.array(*[F.col(quote(f)).cast("double") for f in spec.features])


def projected_vector(spec: FeatureSpec, n_dims: int, signed: bool = True) -> Column:
    """array<double> of n_dims projections.

    Numbers and category tokens pass through Arrow once and are projected batch by batch: as generated expressions,
    60 projections are a method too long for the JVM to compile. A missing value contributes nothing.
    """
    numbers = [F.coalesce(F.col(quote(f)).cast("double"), F.lit(0.0)) for f in spec.numeric]
    tokens = [F.col(quote(f)).cast("string") for f in spec.categories]
    return feature_weights(spec.numeric, numbers, spec.categories, tokens, n_dims, signed)


def vectorize(
    df: DataFrame, spec: FeatureSpec, n_dims: int | None = None, signed: bool = True
) -> DataFrame:
    """(row_id, x) with x the plain or projected feature vector."""
    rows = split_roles(df, spec)
    role = FeatureSpec(spec.features, spec.categorical, ID)
    x = plain_vector(role) if n_dims is None else projected_vector(role, n_dims, signed)
    return rows.select(ID, x.alias("x"))


def projection_table(spark, tokens: list[str], n_dims: int, signed: bool = True) -> DataFrame:
    """The projection matrix of the given tokens as (token, k, r)."""
    weights = projection_weights(tokens, n_dims, signed)
    rows = [(t, [float(v) for v in weights[i]]) for i, t in enumerate(tokens)]
    schema = T.StructType(
        [T.StructField("token", T.StringType()), T.StructField("r", T.ArrayType(T.DoubleType()))]
    )
    return spark.createDataFrame(rows, schema).select("token", F.posexplode("r").alias("k", "r"))
