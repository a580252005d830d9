"""Ranking and classification metrics as aggregations of (score, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.functions.prefix import running_totals
from strayrows.operators.chains import top_k


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score with totals over higher-or-equal scores."""
    grouped = scored.groupBy("score").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"),
    )
    return running_totals(grouped, F.desc("score"), ["pos", "neg"])


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row `auc`: chance that a positive outranks a negative, ties counting half."""
    c = _by_score(scored)
    ordered = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return c.agg(
        F.try_divide(ordered, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc")
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """One row `ap`: precision at every score weighted by the recall it adds."""
    c = _by_score(scored)
    gain = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return c.agg(F.try_divide(F.sum(gain), F.sum("pos")).alias("ap"))


def precision_at_k(scored: DataFrame, k: int) -> DataFrame:
    """One row `precision_at_k` over the k highest scores."""
    return top_k(scored, k).agg(F.avg(F.col("label").cast("double")).alias("precision_at_k"))


def f1(predicted: DataFrame) -> DataFrame:
    """One row `f1` from 0/1 columns `label` and `prediction`."""
    hit = F.sum(F.col("label") * F.col("prediction"))
    either = F.sum(F.col("label") + F.col("prediction"))
    return predicted.agg(F.try_divide(2.0 * hit, either).alias("f1"))


def outlier_share(labelled: DataFrame) -> DataFrame:
    """One row `contamination`: the share of label 1."""
    return labelled.agg(F.avg(F.col("label").cast("double")).alias("contamination"))


def class_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("n"))


def mean_over_runs(per_run: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric over rows keyed by `run`."""
    return per_run.groupBy("run").agg(F.avg(metric).alias(metric)).agg(
        F.avg(metric).alias(f"mean_{metric}"), F.count("*").alias("n_runs")
    )
