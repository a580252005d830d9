"""Readers and writers for input tables and results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrows.spec import ID, FeatureSpec, quote


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    missing: str = "",
    sep: str = ",",
) -> DataFrame:
    """Delimited text; `missing` is the marker of an absent value (for example `?`).

    Without a schema the types are inferred, which costs a pass over the file.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("nullValue", missing)
    reader = reader.option("ignoreLeadingWhiteSpace", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


_DECLARED = r"(?i)^\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*?)\s*$"
_NUMERIC = ("real", "numeric", "integer")


def declared_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema that a file's `@attribute` lines declare: numbers are doubles, all else is text.

    The lines are read by Spark, from whatever store the file lies in, in the file's order.
    """
    lines = spark.read.text(path).where(F.lower(F.ltrim("value")).startswith("@attribute"))
    at = F.col("_metadata.file_block_start")
    found = lines.select(at.alias("at"), F.monotonically_increasing_id().alias("i"), F.regexp_extract("value", _DECLARED, 1).alias("name"), F.regexp_extract("value", _DECLARED, 2).alias("kind"))
    rows = found.orderBy("at", "i").collect()  # one row per column
    return T.StructType(
        [T.StructField(r["name"].strip("'\""), T.DoubleType() if r["kind"].lower() in _NUMERIC else T.StringType()) for r in rows]
    )


def read_attribute_file(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, missing: str = "?"
) -> DataFrame:
    """Data rows of a text file that also holds `%` comments and `@` declarations, which give the schema if none is given."""
    if schema is None:
        schema = declared_schema(spark, path)
    lines = spark.read.text(path).where(
        (F.trim("value") != "") & ~F.col("value").rlike(r"^\s*[%@]")
    )
    parsed = F.from_csv("value", schema if isinstance(schema, str) else _ddl(schema),
                        {"nullValue": missing, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "quote": "'"})
    return lines.select(parsed.alias("r")).select("r.*")


def named_schema(spark: SparkSession, names: str, label: str = "class") -> T.StructType:
    """The schema that a `.names` file gives: after the class values, `name: continuous.` or `name: a, b.` line by line.

    `|` starts a comment. Continuous columns are doubles, all else is text; `label` comes first.
    """
    text = F.trim(F.regexp_replace("value", r"\|.*$", ""))
    lines = spark.read.text(names).select(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), text.alias("line"))
    rows = lines.where(F.col("line").contains(":")).orderBy("at", "i").collect()  # one row per column
    fields = [T.StructField(label, T.StringType())]
    for r in rows:
        name, kind = r["line"].split(":", 1)
        number = kind.strip().rstrip(".").strip().lower() == "continuous"
        fields.append(T.StructField(name.strip(), T.DoubleType() if number else T.StringType()))
    return T.StructType(fields)


def read_named(spark: SparkSession, path: str, names: str, label: str = "class", missing: str = "?", label_last: bool = False) -> DataFrame:
    """A file without a header whose columns a `.names` file describes; the label comes first, or last."""
    schema = named_schema(spark, names, label)
    if label_last:
        schema = T.StructType([*schema.fields[1:], schema.fields[0]])
    return read_delimited(spark, path, schema, header=False, missing=missing)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def read_parquet(spark: SparkSession, path: str, spread: bool = True) -> DataFrame:
    """Parquet; a file too small to split is spread over the available cores.

    Large inputs already have more splits than cores and are left alone.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if not spread or len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = 128 * 1024 * 1024
    if math.ceil(size / split) >= cores:
        return df
    return df.repartition(cores)


def write_scores(scores: DataFrame, path: str, text: bool = False) -> None:
    """Key, score and label if present; text is headerless CSV."""
    columns = [ID, "score"] + [c for c in ("score_norm", "label") if c in scores.columns]
    _write(scores.select(*columns), path, text)


def widen(attribution: DataFrame, spec: FeatureSpec, suffix: str = "_ex") -> DataFrame:
    """One column `<feature>_ex` per feature from long (row_id, feature, importance)."""
    wide = attribution.groupBy(ID).pivot("feature", list(spec.features)).agg(F.first("importance"))
    return wide.select(
        ID, *[F.coalesce(F.col(quote(f)), F.lit(0.0)).alias(f + suffix) for f in spec.features]
    )


def lengthen(wide: DataFrame, spec: FeatureSpec, suffix: str = "_ex") -> DataFrame:
    """Long (row_id, feature, importance) from `<feature>_ex` columns; all must be present."""
    absent = [f for f in spec.features if f + suffix not in wide.columns]
    if absent:
        raise ValueError(f"no importance column for {absent}")
    renamed = wide.select(
        ID, *[F.col(quote(f + suffix)).cast("double").alias(f) for f in spec.features]
    )
    return renamed.unpivot([ID], [quote(f) for f in spec.features], "feature", "importance")


def write_attribution(attribution: DataFrame, spec: FeatureSpec, path: str, text: bool = False) -> None:
    _write(widen(attribution, spec), path, text)


def joined_result(
    source: DataFrame,
    scores: DataFrame,
    attribution: DataFrame,
    embedding: DataFrame,
    clusters: DataFrame,
    best_k: DataFrame,
    spec: FeatureSpec,
) -> DataFrame:
    """All results of the selected rows beside their features, one row per outlier."""
    ks = [r["k"] for r in clusters.select("k").distinct().orderBy("k").collect()]  # one per k
    wide_clusters = clusters.groupBy(ID).pivot("k", ks).agg(F.first("cluster_id"))
    wide_clusters = wide_clusters.select(ID, *[F.col(f"`{k}`").alias(f"{k} clusters") for k in ks])
    features = source.select(F.col(quote(spec.id)).alias(ID), *[quote(f) for f in spec.features])
    return (
        embedding.join(wide_clusters, ID)
        .withColumn("optimal cluster", best_k.select("k").scalar())
        .join(widen(attribution, spec), ID)
        .join(scores, ID)
        .join(features, ID)
    )


def write_members(clusters: DataFrame, source: DataFrame, path: str) -> None:
    """Rows of every cluster, one folder per (k, cluster_id) for pruned reads."""
    (
        source.join(clusters, ID)
        .repartition("k", "cluster_id", F.pmod(F.xxhash64(ID), F.lit(16)))
        .write.mode("overwrite")
        .partitionBy("k", "cluster_id")
        .parquet(path)
    )


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").partitionBy("k", "cluster_id").parquet(path)


def append_rule(accepted: DataFrame, path: str) -> None:
    """Add accepted rules (k, cluster_id, rule_text, coverage, purity) to the saved ones."""
    accepted.write.mode("append").parquet(path)


def write_labelled(table: DataFrame, truth: DataFrame, path: str) -> None:
    """A synthesised table and the importances it was built with."""
    table.write.mode("overwrite").parquet(f"{path}/table")
    truth.write.mode("overwrite").parquet(f"{path}/truth")


def _write(df: DataFrame, path: str, text: bool) -> None:
    if text:
        df.write.mode("overwrite").csv(path, header=False)
    else:
        df.write.mode("overwrite").parquet(path)
