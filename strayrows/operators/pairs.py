"""Feature pairs that show a cluster's outliers best, under a budget of plots.

Every distinct pair of top features gets a small ensemble of its own. With exact counts the
ensembles are stacked into one plan. With counters a pair is a unit of `partitioned.py`: all
pairs together take three scans of the raw features (ranges, counts, scores), however many there are,
and a row meets a pair as two numbers, projected where they are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrows.functions.blocks import joined, matrices
from strayrows.functions.joins import lookup
from strayrows.functions.tokens import murmur3, projection_weights
from strayrows.operators import partitioned as T
from strayrows.operators.chains import (
    SCORE_DIGITS,
    ChainPlan,
    fit_plan,
    half_ranges,
    normalise,
    ranges,
)
from strayrows.operators.countmin import SketchShape, buckets, few_tasks
from strayrows.spec import ID, double, quote
from strayrows.staging import stage

GROUP = ["k", "cluster_id"]
Pair = tuple[str, str]


def feature_pairs(focus: DataFrame, features: Sequence[str]) -> DataFrame:
    """(k, cluster_id, plot, fx, fy): pairs of each cluster's top features.

    Plots are numbered in rank order; fx comes before fy in table order, so one
    pair has one name in all clusters.
    """
    a = focus.select(*GROUP, F.col("feature").alias("f1"), F.col("rank").alias("r1"))
    b = focus.select(*GROUP, F.col("feature").alias("f2"), F.col("rank").alias("r2"))
    names = F.array(*[F.lit(f) for f in features])
    swap = F.array_position(names, F.col("f1")) > F.array_position(names, F.col("f2"))
    order = Window.partitionBy(*GROUP).orderBy("r1", "r2")  # pairs of a few top features
    return a.join(b, GROUP).where(F.col("r1") < F.col("r2")).select(
        *GROUP,
        (F.row_number().over(order) - 1).alias("plot"),
        F.when(swap, F.col("f2")).otherwise(F.col("f1")).alias("fx"),
        F.when(swap, F.col("f1")).otherwise(F.col("f2")).alias("fy"),
    )


def distinct_pairs(pairs: DataFrame) -> list[Pair]:
    """The pairs to score; their number is bounded by the squared number of features."""
    return [(r["fx"], r["fy"]) for r in pairs.select("fx", "fy").distinct().orderBy("fx", "fy").collect()]


def pair_terms(fx: str, fy: str, n_dims: int | None) -> list[list[tuple[str, float]]]:
    """Per dimension of the pair's space, its features and their weights."""
    if n_dims is None:
        return [[(fx, 1.0)], [(fy, 1.0)]]
    w = projection_weights(["0", "1"], n_dims)
    return [
        [(f, float(w[i, k])) for i, f in enumerate((fx, fy)) if w[i, k] != 0.0]
        for k in range(n_dims)
    ]


@dataclass(frozen=True)
class PairDetector:
    """Detector settings; `shape=None` counts exactly, otherwise with count-min counters.

    A chain that halves `depth` times the two features of a pair has some 2^depth cells however many rows
    there are, so 2^(depth + 2) counters do not fill up; the default fits the default depth.
    """

    n_dims: int | None = 50
    n_chains: int = 50
    depth: int = 10
    seed: int = 0
    shape: SketchShape | None = SketchShape(bits=12)

    @property
    def width(self) -> int:
        return 2 if self.n_dims is None else self.n_dims

    def own_plan(self, pair: Pair) -> ChainPlan:
        """A pair's draw depends on its own name only."""
        seed = int(murmur3(["|".join(pair)], 1)[0, 0]) + self.seed
        return ChainPlan.draw(self.width, self.n_chains, self.depth, seed)

    def plan(self, pairs: Sequence[Pair]) -> ChainPlan:
        """The pairs' ensembles side by side."""
        dims: list[tuple[int, ...]] = []
        shift: list[dict[int, float]] = []
        for p, pair in enumerate(pairs):
            own = self.own_plan(pair)
            for c in range(self.n_chains):
                dims.append(tuple(k + p * self.width for k in own.dims[c]))
                shift.append({k + p * self.width: own.shift[c][k] for k in set(own.dims[c])})
        return ChainPlan(tuple(dims), tuple(shift), self.n_chains)

    def vectors(self, rows: DataFrame, pairs: Sequence[Pair], *keep: str) -> DataFrame:
        """(row_id, x) with the coordinates of all pairs one after the other."""
        entries = []
        for fx, fy in pairs:
            for terms in pair_terms(fx, fy, self.n_dims):
                entries.append(
                    " + ".join(f"CAST({quote(f)} AS DOUBLE) * {double(w)}" for f, w in terms) or "0D"
                )
        return rows.select(ID, *keep, F.expr("array(" + ", ".join(entries) + ")").alias("x"))

    def score(self, rows: DataFrame, pairs: Sequence[Pair], outliers: DataFrame) -> DataFrame:
        """(fx, fy, row_id, score, score_norm) of the outliers, normalised over all rows."""
        if self.shape is None:
            return self._exact(rows, pairs).join(outliers.select(ID), ID, "left_semi")
        marks = stage(outliers.select(ID).distinct().withColumn("hit", F.lit(True)), "marks")
        marked = lookup(rows, marks, [ID]).withColumn("hit", F.col("hit").isNotNull())
        return self._counted(rows, marked, pairs)

    def score_all(self, rows: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
        """(fx, fy, row_id, score, score_norm) of every row, exact counts."""
        return self._exact(rows, pairs)

    def _exact(self, rows: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
        plan = self.plan(pairs)
        vectors = self.vectors(rows, pairs)
        model = fit_plan(vectors, plan, ranges(vectors, self.width * len(pairs)))
        scores = model.score(vectors, fitted=True)
        if plan.n_ensembles == 1:
            scores = scores.withColumn("ensemble", F.lit(0))
        return _named(normalise(stage(scores, "pair-scores"), ["ensemble"]), pairs)

    def weights(self) -> np.ndarray:
        """[2, dim]: what the features of a pair add to each dimension of its space."""
        return np.eye(2) if self.n_dims is None else np.asarray(projection_weights(["0", "1"], self.n_dims))

    def bounds(self, vectors: DataFrame, at: Sequence[tuple[int, int]]) -> list[list[float]]:
        """Half the range of every dimension of every pair, in one scan of the features.

        A space has few different dimensions, as weights are signs: at most nine per pair reach the driver.
        """
        axes, own = np.unique(self.weights(), axis=1, return_inverse=True)

        def extremes(batches):
            lo = np.full((len(at), axes.shape[1]), np.inf)
            hi = -lo
            for _, x in matrices(batches):
                for p, (i, j) in enumerate(at):
                    y = axes[0][:, None] * x[i] + axes[1][:, None] * x[j]
                    lo[p] = np.fmin(lo[p], np.fmin.reduce(y, axis=1))
                    hi[p] = np.fmax(hi[p], np.fmax.reduce(y, axis=1))
            p, k = np.indices(lo.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(lo.ravel()), pa.array(hi.ravel())],
                ["pair", "axis", "lo", "hi"],
            )

        each = vectors.select("x").mapInArrow(extremes, "pair int, axis int, lo double, hi double")
        found = {(r["pair"], r["axis"]): (r["lo"], r["hi"]) for r in each.groupBy("pair", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        return [half_ranges([found[p, int(k)] for k in own.ravel()]) for p in range(len(at))]

    def _counted(self, rows: DataFrame, marked: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
        """Scores every row but emits only outliers and each group's extremes."""
        features = sorted({f for p in pairs for f in p})
        at = [(features.index(fx), features.index(fy)) for fx, fy in pairs]
        number = [F.col(quote(f)).cast("double") for f in features]
        vectors = rows.select(ID, F.array(*number).alias("x"))
        deltas, plans = self.bounds(vectors, at), [self.own_plan(p) for p in pairs]
        w, shape, n_chains, depth = self.weights(), self.shape, self.n_chains, self.depth
        size = n_chains * depth * shape.hashes * shape.width

        def space(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return w[0][:, None] * a + w[1][:, None] * b

        def counting(x: np.ndarray):
            for p, (i, j) in enumerate(at):
                index = (i for _, _, own in buckets(space(x[i], x[j]), plans[p], deltas[p], shape) for i in own)
                yield (p, *T.filled(index, shape.width))

        blocks = lambda batches: (x for _, x in matrices(batches))
        tasks = few_tasks(vectors)
        parts = T.partials(vectors.select("x").coalesce(tasks), blocks, counting, 8 * len(w[0]))
        packed = stage(T.summed(parts, tasks, size), "pair-counters")

        def scored(p: int, own: pa.Table, tables: dict) -> pa.Table:
            (ids, hit), x = joined(own.select([ID, "hit", "x"]).to_batches())
            counts = T.dense(tables.get(p), size).reshape(-1, shape.width)
            total = np.zeros(x.shape[1])
            for c, d, index in buckets(space(x[0], x[1]), plans[p], deltas[p], shape):
                base = (c * depth + d) * shape.hashes
                least = counts[base][index[0]]
                for j in range(1, shape.hashes):
                    least = np.minimum(least, counts[base + j][index[j]])
                v = np.log2(1.0 + least) + (d + 1)
                low = v if d == 0 else np.minimum(low, v)
                if d == depth - 1:
                    total -= low
            total = np.round(total / n_chains, SCORE_DIGITS)
            chosen = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            return pa.table({
                ID: pa.array([None, *ids.to_numpy()[chosen].tolist()], pa.int64()),
                "ensemble": pa.array(np.full(len(chosen) + 1, p, np.int32)),
                "score": pa.array([total.min(), *total[chosen]]),
                "hi": pa.array([total.max(), *[None] * len(chosen)], pa.float64()),
            })

        one = [F.struct(F.lit(p).alias("unit"), F.array(number[i], number[j]).alias("x")) for p, (i, j) in enumerate(at)]
        spread = marked.select(ID, "hit", F.inline(F.array(*one)))
        schema = f"{ID} bigint, ensemble int, score double, hi double"
        out = stage(T.met(spread, rows.count(), packed, 1, len(pairs), scored, schema), "pair-scores")
        # One row per pair.
        ends = out.where(F.col(ID).isNull()).groupBy("ensemble").agg(
            F.min("score").alias("_lo"), F.max("hi").alias("_hi")
        )
        norm = F.coalesce(
            F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)
        )
        chosen = out.where(F.col(ID).isNotNull()).join(F.broadcast(ends), "ensemble")
        return _named(chosen.withColumn("score_norm", norm), pairs)


def _named(scores: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    fx = F.array(*[F.lit(p[0]) for p in pairs])
    fy = F.array(*[F.lit(p[1]) for p in pairs])
    return scores.select(
        fx[F.col("ensemble")].alias("fx"),
        fy[F.col("ensemble")].alias("fy"),
        ID,
        "score",
        F.round("score_norm", SCORE_DIGITS).alias("score_norm"),
    )


def _cluster_scores(scores: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Outlier scores on the pairs of the outlier's own clusters."""
    return scores.join(clusters, ID).join(pairs, [*GROUP, "fx", "fy"])


def best_pairs(scores: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, cluster_id, row_id, plot, fx, fy, score): each outlier's best pair, the later on ties."""
    best = _cluster_scores(scores, clusters, pairs).groupBy(*GROUP, ID).agg(
        F.max(F.struct("score_norm", "plot", "fx", "fy")).alias("b")
    )
    return best.select(
        *GROUP, ID, "b.plot", "b.fx", "b.fy", F.col("b.score_norm").alias("score")
    )


def rank_pairs(assigned: DataFrame) -> DataFrame:
    """(k, cluster_id, plot, fx, fy, total, n, rank): pairs by the score they collect."""
    order = Window.partitionBy(*GROUP).orderBy(F.desc(F.round("total", SCORE_DIGITS)), "plot")
    return (
        assigned.groupBy(*GROUP, "plot", "fx", "fy")
        .agg(F.sum("score").alias("total"), F.count("*").alias("n"))
        .withColumn("rank", F.row_number().over(order))
    )


def within_budgets(
    scores: DataFrame, clusters: DataFrame, ranked: DataFrame, max_budget: int = 5
) -> DataFrame:
    """(k, cluster_id, budget, rank, fx, fy, row_id, score): outliers re-assigned among the
    best `budget` pairs, for every budget from 1."""
    allowed = ranked.where(F.col("rank") <= max_budget).select(
        *GROUP,
        "rank",
        "fx",
        "fy",
        F.explode(F.sequence(F.col("rank"), F.lit(max_budget))).alias("budget"),
    )
    best = _cluster_scores(scores, clusters, allowed).groupBy(*GROUP, "budget", ID).agg(
        F.max(F.struct("score_norm", "rank", "fx", "fy")).alias("b")
    )
    return best.select(
        *GROUP, "budget", "b.rank", "b.fx", "b.fy", ID, F.col("b.score_norm").alias("score")
    )


def budget_totals(budgeted: DataFrame, ranked: DataFrame, max_budget: int = 5) -> DataFrame:
    """(k, cluster_id, budget, rank, fx, fy, total, n) for every allowed pair, 0 where it explains nothing."""
    allowed = ranked.where(F.col("rank") <= max_budget).select(
        *GROUP, "rank", "fx", "fy",
        F.explode(F.sequence(F.col("rank"), F.lit(max_budget))).alias("budget"),
    )
    keys = [*GROUP, "budget", "rank", "fx", "fy"]
    sums = budgeted.groupBy(*keys).agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    return allowed.join(sums, keys, "left").select(
        *keys,
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def plot_roles(
    rows: DataFrame,
    outliers: DataFrame,
    clusters: DataFrame,
    budgeted: DataFrame,
    k: int,
    cluster_id: int,
    budget: int,
    rank: int,
) -> DataFrame:
    """(row_id, role) for one plot: 0 normal, 1 explained here, 2 other outlier of the cluster,
    3 outlier of another cluster."""
    in_cluster = clusters.where((F.col("k") == k) & (F.col("cluster_id") == cluster_id))
    here = budgeted.where(
        (F.col("k") == k)
        & (F.col("cluster_id") == cluster_id)
        & (F.col("budget") == budget)
        & (F.col("rank") == rank)
    )
    marks = (
        outliers.select(ID)
        .join(in_cluster.select(ID, F.lit(True).alias("mine")), ID, "left")
        .join(here.select(ID, F.lit(True).alias("here")), ID, "left")
        .select(
            ID,
            F.when(F.col("here"), 1).when(F.col("mine"), 2).otherwise(3).alias("role"),
        )
    )
    return rows.select(ID).join(marks, ID, "left").withColumn("role", F.coalesce("role", F.lit(0)))
