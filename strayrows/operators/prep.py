"""Cleaning, encoding and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrows.functions.joins import lookup
from strayrows.functions.prefix import running_totals
from strayrows.spec import ID, FeatureSpec, quote
from strayrows.staging import stage


#: Tasks a core for rows that are put in order.
ORDER_TASKS = 4


def force_numeric(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Cast to double; unparsable text fails, or becomes NULL with strict=False."""
    cast = (lambda c: c.cast("double")) if strict else (lambda c: c.try_cast("double"))
    return df.withColumns({c: cast(F.col(quote(c))) for c in columns})


def drop_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a missing, NaN or infinite value in any of the columns."""
    keep = F.lit(True)
    for c in columns:
        v = F.col(quote(c)).cast("double")
        keep = keep & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return df.where(keep)


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_").lower() for c in df.columns])


def binary_label(df: DataFrame, column: str, normal_value: str, label: str = "label") -> DataFrame:
    """Replace a text column by 0 (normal value) or 1 (anything else)."""
    flag = F.when(F.col(quote(column)) == normal_value, 0).otherwise(1)
    return df.withColumn("_flag", flag).drop(column).withColumnRenamed("_flag", label)


def with_row_key(df: DataFrame, dense: bool = False, name: str = ID) -> DataFrame:
    """Add a unique row key; `dense` numbers rows 0..n-1 partition after partition.

    The rows are staged with their keys: a key that depends on where a row was read must not be drawn twice.
    """
    if not dense:
        return stage(df.withColumn(name, F.monotonically_increasing_id()), "keyed")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stage(
        df.withColumn("_part", F.spark_partition_id()).withColumn("_pos", position), "numbered"
    )
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = running_totals(sizes, F.col("_part"), ["n"]).select(
        "_part", (F.col("cum_n") - F.col("n")).alias("_offset")
    )
    # One row per input partition, which is what gets broadcast.
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): the categories of each column numbered from 0 in sorted order, from one scan."""
    named = [F.struct(F.lit(c).alias("column"), F.col(quote(c)).cast("string").alias("value")) for c in columns]
    distinct = df.select(F.inline(F.array(*named))).where("value IS NOT NULL").distinct().withColumn("one", F.lit(1))
    upto = stage(running_totals(distinct, F.struct("column", "value"), ["one"]), "codes")
    first = upto.groupBy("column").agg(F.min("cum_one").alias("first"))  # one row a column
    return upto.join(F.broadcast(first), "column").select("column", "value", (F.col("cum_one") - F.col("first")).alias("code"))


def encode(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace categories by their codes; also returns the code tables."""
    if not columns:
        return df, {}
    tables, every = {}, stage(category_codes(df, columns), "codes")
    for c in columns:
        codes = tables[c] = every.where(F.col("column") == c).select("value", "code")
        named = codes.select(F.col("value").alias(c), F.col("code").alias("_code"))
        df = (
            lookup(df.withColumn(c, F.col(quote(c)).cast("string")), named, [c])
            .withColumn(c, F.col("_code"))
            .drop("_code")
            .select(*[quote(n) for n in df.columns])
        )
    return df, tables


def decode(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Inverse of encode."""
    for c, codes in tables.items():
        named = codes.select(F.col("code").alias(c), F.col("value").alias("_value"))
        df = (
            lookup(df, named, [c])
            .withColumn(c, F.col("_value"))
            .drop("_value")
            .select(*[quote(n) for n in df.columns])
        )
    return df


def one_hot(column: Column, categories: Sequence[str]) -> Column:
    """0/1 array over the categories; an unknown value is all zero."""
    known = F.array(*[F.lit(c) for c in categories])
    return F.transform(known, lambda c: F.when(column == c, F.lit(1.0)).otherwise(F.lit(0.0)))


def one_hot_inverse(vector: Column, sizes: Sequence[int]) -> Column:
    """Position of the largest entry in every category block (first on ties); null where none is positive."""
    picks, at = [], 1
    for n in sizes:
        block = F.slice(vector, at, n)
        place = (F.array_position(block, F.array_max(block)) - 1).cast("int")
        picks.append(F.when(F.array_max(block) > 0, place))
        at += n
    return F.array(*picks)


def limits(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(min, max) of each column: two numbers per column come to the driver."""
    row = df.agg(
        *[F.min(F.col(quote(c)).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(quote(c)).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def min_max(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Scale columns to 0..1; a constant column becomes 0."""
    scaled = {}
    for c, (lo, hi) in bounds.items():
        v = F.col(quote(c)).cast("double")
        scaled[c] = F.lit(0.0) if hi == lo else (v - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumns(scaled)


def denormalise(
    df: DataFrame, bounds: dict[str, tuple[float, float]], as_int: bool = False
) -> DataFrame:
    """Inverse of min_max, truncated to integers on request."""
    restored = {}
    for c, (lo, hi) in bounds.items():
        v = F.col(quote(c)) * F.lit(hi - lo) + F.lit(lo)
        restored[c] = v.cast("long") if as_int else v
    return df.withColumns(restored)


def clip_low(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise negative values to 0; the upper limit is the column maximum itself."""
    return df.withColumns({c: F.greatest(F.lit(0.0), F.col(quote(c))) for c in columns})


def reorder(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Columns in the order of the original table."""
    tail = [spec.label] if spec.label and spec.label in df.columns else []
    return df.select(*[quote(c) for c in (spec.id, *spec.features, *tail)])


def flag_outliers(df: DataFrame, outliers: DataFrame) -> DataFrame:
    """Add anomaly = 1 for rows whose key is among the outliers, else 0."""
    marks = outliers.select(ID).distinct().withColumn("_hit", F.lit(1))
    return (
        df.join(marks, ID, "left")
        .withColumn("anomaly", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def normal_rows(df: DataFrame, outliers: DataFrame) -> DataFrame:
    return df.join(outliers.select(ID), ID, "left_anti")


def outlier_rows(df: DataFrame, outliers: DataFrame) -> DataFrame:
    return df.join(outliers.select(ID), ID, "left_semi")


def score_or_label(result: DataFrame, use_label: bool) -> DataFrame:
    """(row_id, value): the label or the score of each selected row."""
    column = "label" if use_label else "score"
    if column not in result.columns:
        raise ValueError(f"the result has no column {column}")
    return result.select(ID, F.col(column).cast("double").alias("value"))


def select_outliers(scored: DataFrame, k: int, use_label: bool = False) -> DataFrame:
    """The k highest scores, or every row with label 1."""
    if use_label:
        if "label" not in scored.columns:
            raise ValueError("selection by label needs a label column")
        return scored.where(F.col("label") == 1)
    return scored.orderBy(F.desc("score"), F.asc(ID)).limit(k)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(ID).limit(n)


def alike_adjacent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in an order of `columns`, so that equal ones follow each other; the key as the last one spreads frequent values."""
    order = [F.col(quote(c)) for c in (*columns, ID)]
    tasks = ORDER_TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in a random order fixed by the seed."""
    return df.orderBy(F.xxhash64(F.col(ID), F.lit(seed)), ID)
