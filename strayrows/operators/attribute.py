"""Which features make a row unusual.

The importance of every split dimension comes from the chains; when dimensions
are random projections it is carried back to features over the row's own
feature-projection incidence. That graph has at most features x projections
edges per row, so it lives in array columns and the fixed-round walks below run
row-locally: no shuffle, no driver loop, no lineage growth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrows.functions.arrays import dot, let, safe_divide, share, total, unit
from strayrows.functions.tokens import projection_weights, token, token_weights
from strayrows.spec import ID, FeatureSpec, quote

TIE_DIGITS = 9


def dimension_importance(depth_scores: DataFrame, n_dims: int) -> DataFrame:
    """(row_id, imp array): importance of each split dimension for each row.

    A chain counts up to its arg-min depth (the first on ties); every split on
    the way adds the distance to the largest value seen, shared over the chains
    that use the dimension plus one. Dimensions never used get 0.
    """
    d = depth_scores.withColumn("v", F.round("v", TIE_DIGITS))
    largest = d.agg(F.max("v")).scalar()
    along = Window.partitionBy(ID, "chain")
    used = (
        d.withColumn("stop", F.min(F.struct("v", "depth")).over(along)["depth"])
        .where(F.col("depth") <= F.col("stop"))
        .groupBy(ID, "split", "chain")
        .agg(F.sum(largest - F.col("v")).alias("gain"))
        .groupBy(ID, "split")
        .agg((F.sum("gain") / (F.count("*") + 1)).alias("imp"))
    )
    by_dim = F.map_from_entries(F.collect_list(F.struct("split", "imp")))  # at most n_dims entries
    return used.groupBy(ID).agg(by_dim.alias("m")).select(
        ID,
        F.transform(
            F.sequence(F.lit(0), F.lit(n_dims - 1)),
            lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)),
        ).alias("imp"),
    )


def membership(rows: DataFrame, spec: FeatureSpec, n_dims: int) -> DataFrame:
    """(row_id, member array<array>): per feature, 1 on every projection its token takes part in."""
    weights = projection_weights(spec.features, n_dims, signed=False)
    per_feature = []
    for i, f in enumerate(spec.features):
        if f in spec.categorical:
            per_feature.append(
                token_weights(token(f, F.col(quote(f)).cast("string")), n_dims, signed=False)
            )
        else:
            per_feature.append(F.array(*[F.lit(float(v)) for v in weights[i]]))
    return rows.select(F.col(quote(spec.id)).alias(ID), F.array(*per_feature).alias("member"))


def edges(members: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The incidence as rows (row_id, feature, k)."""
    names = F.array(*[F.lit(f) for f in spec.features])
    per_feature = members.select(ID, F.posexplode("member").alias("i", "w"))
    return (
        per_feature.select(ID, names[F.col("i")].alias("feature"), F.posexplode("w").alias("k", "r"))
        .where(F.col("r") != 0)
        .select(ID, "feature", "k")
    )


def _transposed(m: Column, width: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), width - 1), lambda k: F.transform(m, lambda row: row[k])
    )


def _rows_to_shares(m: Column) -> Column:
    return F.transform(m, share)


def _shifted(imp: Column) -> Column:
    return let(
        F.least(F.array_min(imp), F.lit(0.0)), lambda low: F.transform(imp, lambda v: v - low)
    )


def _times(m: Column, v: Column, by: float = 1.0) -> Column:
    return F.transform(m, lambda row: F.lit(by) * dot(row, v))


def _mixed(m: Column, v: Column, restart: Column, alpha: float) -> Column:
    return F.zip_with(
        m, restart, lambda row, q: F.lit(alpha) * dot(row, v) + F.lit(1 - alpha) * q
    )


def _rounds(n: int, dr: Column, pr: Column, step: Callable) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(n)),
        F.struct(dr.alias("dr"), pr.alias("pr")),
        lambda state, _: step(state["dr"], state["pr"]),
    )


def average(imp: Column, member: Column) -> Column:
    """Mean importance of the projections a feature takes part in, 0 for none."""
    return F.transform(member, lambda row: safe_divide(dot(row, imp), total(row)))


def random_walk(imp: Column, member: Column, alpha: float = 0.5, rounds: int = 10) -> Column:
    """Walk between projections and features that restarts at the important projections."""
    n_dims, n_features = F.size(imp), F.size(member)
    weighted = F.transform(member, lambda row: F.zip_with(row, imp, lambda m, v: m * v))
    to_dims = _transposed(_rows_to_shares(weighted), n_dims)
    to_features = _transposed(_rows_to_shares(_transposed(weighted, n_dims)), n_features)

    def walk(graph: Column) -> Column:
        def step(dr, pr):
            moved = F.struct(
                _times(graph["to_features"], pr, alpha).alias("dr"),
                _mixed(graph["to_dims"], dr, graph["restart"], alpha).alias("pr"),
            )
            return let(
                moved,
                lambda s: let(
                    total(s["dr"]) + total(s["pr"]),
                    lambda mass: F.struct(
                        F.transform(s["dr"], lambda v: safe_divide(v, mass)).alias("dr"),
                        F.transform(s["pr"], lambda v: safe_divide(v, mass)).alias("pr"),
                    ),
                ),
            )

        start = F.lit(1.0) / (n_dims + n_features)
        end = _rounds(
            rounds, F.array_repeat(start, n_features), F.array_repeat(start, n_dims), step
        )
        return let(end["dr"], share)

    graph = F.struct(
        to_dims.alias("to_dims"),
        to_features.alias("to_features"),
        let(_shifted(imp), share).alias("restart"),
    )
    return let(graph, walk)


def hits(imp: Column, member: Column, alpha: float = 0.5, rounds: int = 20) -> Column:
    """Hub and authority scores with restart at the row's importances."""
    n_dims, n_features = F.size(imp), F.size(member)
    per_dim = _transposed(member, n_dims)

    def walk(graph: Column) -> Column:
        def step(_, pr):
            return let(
                unit(_times(graph["to_features"], pr)),
                lambda dr: F.struct(
                    dr.alias("dr"),
                    unit(_mixed(graph["per_dim"], dr, graph["restart"], alpha)).alias("pr"),
                ),
            )

        zero = F.array_repeat(F.lit(0.0), n_features)
        return _rounds(rounds, zero, graph["restart"], step)["dr"]

    graph = F.struct(
        per_dim.alias("per_dim"),
        _transposed(_rows_to_shares(per_dim), n_features).alias("to_features"),
        unit(_shifted(imp)).alias("restart"),
    )
    return let(graph, walk)


def structure_hits(imp: Column, member: Column, start: float = 0.1, rounds: int = 20) -> Column:
    """Centrality of features in the incidence alone; importances are not used."""
    n_dims, n_features = F.size(imp), F.size(member)
    shared = _rows_to_shares(_transposed(member, n_dims))

    def walk(graph: Column) -> Column:
        def step(_, pr):
            return let(
                unit(_times(graph["to_features"], pr)),
                lambda dr: F.struct(
                    dr.alias("dr"), unit(_times(graph["shared"], dr)).alias("pr")
                ),
            )

        zero = F.array_repeat(F.lit(0.0), n_features)
        return _rounds(rounds, zero, F.array_repeat(F.lit(start), n_dims), step)["dr"]

    graph = F.struct(
        shared.alias("shared"), _transposed(shared, n_features).alias("to_features")
    )
    return let(graph, walk)


METHODS: dict[str, Callable[[Column, Column], Column]] = {
    "average": average,
    "random_walk": random_walk,
    "random_walk2": lambda imp, member: random_walk(imp, member, alpha=0.2, rounds=20),
    "hits": hits,
    "signed_hits": structure_hits,
}


def attribute(
    importance: DataFrame,
    spec: FeatureSpec,
    rows: DataFrame | None = None,
    n_dims: int | None = None,
    method: str = "random_walk",
) -> DataFrame:
    """(row_id, feature, importance) from per-dimension importances.

    Without `n_dims` the detector ran on plain features and dimensions are
    features already; otherwise `rows` are the outliers' own feature values.
    """
    if n_dims is None:
        return to_long(importance, "imp", spec.features)
    chosen = METHODS[method]
    joined = importance.join(membership(rows, spec, n_dims), ID)
    return to_long(
        joined.select(ID, chosen(F.col("imp"), F.col("member")).alias("imp")), "imp", spec.features
    )


def to_long(vectors: DataFrame, column: str, features: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    return vectors.select(ID, F.posexplode(column).alias("i", "importance")).select(
        ID, names[F.col("i")].alias("feature"), "importance"
    )


def to_vectors(attribution: DataFrame, features: Sequence[str]) -> DataFrame:
    """(row_id, v array) in feature order from the long form."""
    by_name = F.map_from_entries(F.collect_list(F.struct("feature", "importance")))
    names = F.array(*[F.lit(f) for f in features])
    return attribution.groupBy(ID).agg(by_name.alias("m")).select(
        ID,
        F.transform(names, lambda f: F.coalesce(F.try_element_at("m", f), F.lit(0.0))).alias("v"),
    )


def fold_one_hot(attribution: DataFrame, source_feature: dict[str, str]) -> DataFrame:
    """Importance of source features from (row_id, column, active, importance).

    `source_feature` maps an indicator column to its feature; other columns are
    features themselves with active = 1.
    """
    pairs = [F.lit(v) for item in source_feature.items() for v in item]
    feature = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("column")), F.col("column"))
    return attribution.groupBy(ID, feature.alias("feature")).agg(
        F.sum(F.col("active") * F.col("importance")).alias("importance")
    )


def cluster_importance(attribution: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean importance per (k, cluster_id, feature)."""
    return (
        attribution.join(clusters, ID)
        .groupBy("k", "cluster_id", "feature")
        .agg(F.avg("importance").alias("importance"))
    )


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The n most important features of every cluster with their rank from 1."""
    order = Window.partitionBy("k", "cluster_id").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def row_importance(attribution: DataFrame, row_id: int) -> DataFrame:
    """Features of one row, most important first."""
    return attribution.where(F.col(ID) == row_id).orderBy(F.desc("importance"), "feature")
