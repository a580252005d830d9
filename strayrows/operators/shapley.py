"""Attribution of any score function by sampled permutations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrows.operators.chains import literal_table
from strayrows.spec import ID
from strayrows.staging import stage

ScoreFunction = Callable[[DataFrame], DataFrame]


def shapley(
    outliers: DataFrame,
    background: DataFrame,
    score: ScoreFunction,
    features: Sequence[str],
    n_permutations: int = 16,
    n_background: int = 64,
    seed: int = 0,
) -> DataFrame:
    """(row_id, feature, importance) of (row_id, x) rows under `score`.

    Each outlier meets every permutation with one background row; features are
    switched from background to outlier in permutation order, all mixtures are
    scored as one table, and a feature's share is the mean change it causes. For
    a row the shares add up to its score minus the mean score of its background.
    """
    rng = np.random.default_rng(seed)
    n = len(features)
    permutations = [
        {"p": p, "place": [int(v) for v in np.argsort(rng.permutation(n))]}
        for p in range(n_permutations)
    ]
    # n_background rows, so one small window numbers them.
    chosen = background.orderBy(F.xxhash64(F.col(ID), F.lit(seed)), ID).limit(n_background)
    numbered = stage(
        chosen.select(
            (F.row_number().over(Window.orderBy(F.xxhash64(F.col(ID), F.lit(seed)), ID)) - 1).alias("b"),
            F.col("x").alias("bx"),
        ),
        "background",
    )
    size = numbered.count()
    table = literal_table(permutations, "array<struct<p:int,place:array<int>>>")
    games = (
        outliers.select(ID, "x", F.explode(table).alias("g"))
        .select(ID, "x", "g.p", "g.place")
        .withColumn("b", F.pmod(F.xxhash64(F.col(ID), F.col("p")), F.lit(size)).cast("int"))
        .join(F.broadcast(numbered), "b")  # n_background rows
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    )
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda d: F.when(F.col("place")[d] < F.col("step"), F.col("x")[d]).otherwise(
            F.col("bx")[d]
        ),
    )
    switched = (F.array_position("place", F.col("step") - 1) - 1).cast("int")
    games = stage(
        games.select(
            F.monotonically_increasing_id().alias("game"),
            ID,
            "p",
            "step",
            switched.alias("switched"),
            mixed.alias("x"),
        ),
        "games",
    )
    scored = score(games.select(F.col("game").alias(ID), "x")).select(
        F.col(ID).alias("game"), "score"
    )
    order = Window.partitionBy(ID, "p").orderBy("step")
    names = F.array(*[F.lit(f) for f in features])
    return (
        games.drop("x")
        .join(scored, "game")
        .withColumn("change", F.col("score") - F.lag("score").over(order))
        .where(F.col("step") > 0)
        .groupBy(ID, names[F.col("switched")].alias("feature"))
        .agg(F.avg("change").alias("importance"))
    )


def absolute(attribution: DataFrame) -> DataFrame:
    return attribution.withColumn("importance", F.abs("importance"))
