"""Isolation forest over mixed tables: indicators of categories and scaled numbers, folded back to features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.operators import iforest as I
from strayrows.operators.attribute import fold_one_hot, to_long
from strayrows.operators.metrics import f1
from strayrows.operators.prep import limits, one_hot
from strayrows.operators.ranking import log_rank
from strayrows.operators.trees import split_importance
from strayrows.spec import ID, FeatureSpec, quote
from strayrows.staging import stage


def categories_of(df: DataFrame, spec: FeatureSpec, most: int = 1000) -> dict[str, list[str]]:
    """The values of each category in order, found in one scan; more than `most` in all raise."""
    if not spec.categories:
        return {}
    named = [F.struct(F.lit(f).alias("f"), F.col(quote(f)).cast("string").alias("v")) for f in spec.categories]
    values = df.select(F.explode(F.array(*named)).alias("c")).select("c.f", "c.v").where("v IS NOT NULL").distinct()
    rows = values.limit(most + 1).collect()  # most + 1 rows
    if len(rows) > most:
        raise ValueError(f"more than {most} category values: too many indicator columns")
    return {f: sorted(r["v"] for r in rows if r["f"] == f) for f in spec.categories}


@dataclass
class MixedForest:
    """A fitted forest with the encoding it was fitted on."""

    spec: FeatureSpec
    categories: dict[str, list[str]]
    bounds: dict[str, tuple[float, float]]
    model: I.ForestModel | None = None

    @classmethod
    def fit(cls, df: DataFrame, spec: FeatureSpec, detector: I.ForestDetector) -> MixedForest:
        own = cls(spec, categories_of(df, spec), limits(df, spec.numeric) if spec.numeric else {})
        own.model = detector.fit(own.vectors(df))
        return own

    @property
    def columns(self) -> list[str]:
        """Names of the vector's entries: feature=value, then the numeric features."""
        return [f"{f}={v}" for f, values in self.categories.items() for v in values] + list(self.spec.numeric)

    @property
    def names(self) -> dict[str, str]:
        """The feature of each indicator column."""
        return {f"{f}={v}": f for f, values in self.categories.items() for v in values}

    def vectors(self, df: DataFrame) -> DataFrame:
        """(row_id, x): unknown and null categories have no indicator, null numbers count as the lowest."""
        parts = [one_hot(F.coalesce(F.col(quote(f)).cast("string"), F.lit("")), v) for f, v in self.categories.items() if v]
        numbers = []
        for f, (lo, hi) in self.bounds.items():
            v = F.coalesce(F.col(quote(f)).cast("double"), F.lit(lo))
            numbers.append(F.lit(0.0) if not hi or hi == lo else (v - F.lit(lo)) / F.lit(hi - lo))
        if numbers:
            parts.append(F.array(*numbers))
        return df.select(ID, (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("x"))

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.score(self.vectors(df))

    def attribution(self, df: DataFrame) -> DataFrame:
        """(row_id, feature, importance): of a category only the indicator that is set counts."""
        vectors = self.vectors(df)
        paths = self.model.path_importance(vectors, self.columns).withColumnRenamed("feature", "column")
        numeric = F.col("column").isin(list(self.spec.numeric))
        set_ = to_long(vectors, "x", self.columns).select(
            ID, F.col("feature").alias("column"), F.col("importance").alias("value")
        )
        active = paths.join(set_, [ID, "column"]).withColumn("active", F.when(numeric, 1.0).otherwise(F.col("value")))
        return fold_one_hot(active, self.names) if self.names else active.select(ID, F.col("column").alias("feature"), "importance")


def importance_of_runs(
    df: DataFrame,
    spec: FeatureSpec,
    seeds: Sequence[int],
    n_trees: int = 100,
    sample: int = 256,
    contamination: float = 0.1,
) -> DataFrame:
    """(feature, score, mean_f1) over forests with different seeds; `df` has a label.

    A run's importance of a feature is that of its splits over all rows (`trees.split_importance`), a category's
    indicators together; runs are put together by log rank, beside the mean F1 of their predictions.
    """
    per_run, scores = None, None
    for seed in seeds:
        forest = MixedForest.fit(df, spec, I.ForestDetector(n_trees, sample, seed))
        scored = stage(forest.score(df), "scores")  # one walk for the limit, one for predictions and visits
        least = I.limit(scored, contamination)
        predicted = I.predict_above(scored, least).join(df.select(ID, "label"), ID)
        run = split_importance(forest.model, forest.vectors(df), forest.columns, forest.names, least)
        run = run.select(F.lit(seed).alias("run"), "feature", "importance")
        own = f1(predicted).select(F.lit(seed).alias("run"), "f1")
        per_run = run if per_run is None else per_run.unionByName(run)
        scores = own if scores is None else scores.unionByName(own)
    mean_f1 = scores.agg(F.avg("f1").alias("mean_f1"))  # one row
    return log_rank(stage(per_run, "runs")).join(F.broadcast(mean_f1))
