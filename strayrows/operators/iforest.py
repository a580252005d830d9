"""Isolation forest as a baseline detector, with path-based attribution.

Trees are built from small hash-sampled groups, one group per tree; the node
table is bounded by trees x sample size and travels as a broadcast, so scoring
reads the rows once where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrows.functions.blocks import list_array, matrices
from strayrows.functions.draws import uniform
from strayrows.functions.prefix import running_totals
from strayrows.operators.attribute import to_long
from strayrows.operators.metrics import roc_auc
from strayrows.spec import ID
from strayrows.staging import stage

EULER = 0.5772156649015329
OVERSAMPLE = 4


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def tree_samples(vectors: DataFrame, n_rows: int, n_trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, row_id, x): up to `sample` rows per tree, drawn without replacement.

    Rows are thinned by a hash of their key before they meet the trees, so only
    a few times trees x sample rows are ever expanded or shuffled.
    """
    pool = min(1.0, OVERSAMPLE * n_trees * sample / max(n_rows, 1))
    share = min(1.0, OVERSAMPLE * sample / max(n_rows * pool, 1.0))
    thinned = vectors.where(uniform(F.col(ID), seed, "pool") < pool)
    offered = thinned.select(
        ID, "x", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    ).withColumn("u", uniform(F.col(ID), seed, F.col("tree")))
    order = Window.partitionBy("tree").orderBy("u", ID)  # about OVERSAMPLE x sample rows
    return (
        offered.where(F.col("u") < share)
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= sample)
        .select("tree", ID, "x")
    )


NODE = "tree int, node int, feature int, threshold double, `left` int, `right` int, size int, depth int"


def grow(seed: int, sample: int):
    """Function from one tree's rows to its node table."""
    limit = math.ceil(math.log2(max(sample, 2)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = np.stack(rows.sort_values(ID)["x"])
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        todo = [(np.arange(len(x)), 0, -1, False)]
        while todo:
            at, depth, parent, right = todo.pop()
            node = len(nodes)
            if parent >= 0:
                nodes[parent][5 if right else 4] = node
            part = x[at]
            lo, hi = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(hi > lo)
            if depth >= limit or len(at) <= 1 or not len(varied):
                nodes.append([tree, node, -1, 0.0, -1, -1, len(at), depth])
                continue
            f = int(rng.choice(varied))
            cut = float(rng.uniform(lo[f], hi[f]))
            goes_left = part[:, f] < cut
            nodes.append([tree, node, f, cut, -1, -1, len(at), depth])
            todo.append((at[~goes_left], depth + 1, node, True))
            todo.append((at[goes_left], depth + 1, node, False))
        columns = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
        return pd.DataFrame(nodes, columns=columns)

    return build


@dataclass(frozen=True)
class ForestDetector:
    n_trees: int = 100
    sample: int = 256
    seed: int = 0

    def fit(self, vectors: DataFrame) -> ForestModel:
        n_rows = vectors.count()
        samples = tree_samples(vectors, n_rows, self.n_trees, self.sample, self.seed)
        nodes = samples.groupBy("tree").applyInPandas(grow(self.seed, self.sample), NODE)
        return ForestModel(stage(nodes, "forest"), min(self.sample, n_rows))


@dataclass
class ForestModel:
    nodes: DataFrame
    sample: int

    def shared(self):
        """A broadcast of node arrays per tree; at most trees x 2 x sample nodes."""
        frame = self.nodes.toPandas().sort_values(["tree", "node"])
        trees = [
            {"tree": int(tree)} | {c: part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth")}
            for tree, part in frame.groupby("tree")
        ]
        for t in trees:
            t["next"] = _next(t)
        return self.nodes.sparkSession.sparkContext.broadcast(trees)

    def score(self, vectors: DataFrame) -> DataFrame:
        """(row_id, score) in 0..1; short average paths score high."""
        shared, scale = self.shared(), float(expected_depth(self.sample))

        def score(batches):
            trees = shared.value
            for columns, x in matrices(batches):
                s = unusual((lengths(t)[ends(t, x)] for t in trees), len(trees), scale)
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(s)], [ID, "score"])

        return vectors.select(ID, "x").mapInArrow(score, f"{ID} bigint, score double")

    def path_importance(self, vectors: DataFrame, features: Sequence[str]) -> DataFrame:
        """(row_id, feature, importance): every split on a row's path adds 1/h - 1/h_max,
        divided by how often the feature was used; short paths weigh more."""
        shared, n_features = self.shared(), len(features)

        def attribute(batches):
            trees = shared.value
            for columns, x in matrices(batches):
                n = x.shape[1]
                total, used = np.zeros((n, n_features)), np.zeros((n, n_features))
                rows = np.arange(n)
                for t in trees:
                    steps = list(walk(t, x))
                    h = t["depth"][steps[-1]].astype(float)
                    deepest = max(float(t["depth"].max()), 1.0)
                    gain = 1.0 / np.maximum(h, 1.0) - 1.0 / deepest
                    for before, after in zip(steps, steps[1:]):
                        moved = before != after
                        f = t["feature"][before[moved]]
                        total[rows[moved], f] += gain[moved]
                        used[rows[moved], f] += 1.0
                mean = np.divide(total, used, out=np.zeros_like(total), where=used > 0)
                yield pa.RecordBatch.from_arrays([columns[0], list_array(mean)], [ID, "imp"])

        vectors = vectors.select(ID, "x").mapInArrow(attribute, f"{ID} bigint, imp array<double>")
        return to_long(vectors, "imp", features)


def walk(tree: dict[str, np.ndarray], x: np.ndarray):
    """Node of every row at each level from the root down."""
    rows = np.arange(x.shape[1])
    at = np.zeros(x.shape[1], dtype=np.int64)
    yield at
    for _ in range(int(tree["depth"].max())):
        f = tree["feature"][at]
        inner = f >= 0
        left = x[np.where(inner, f, 0), rows] < tree["threshold"][at]
        at = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)
        yield at


#: Rows that go down a tree together, so that their numbers stay in the cache.
WALK_ROWS = 8192


def _next(tree: dict[str, np.ndarray]) -> np.ndarray:
    """Where a node sends a row: [2 node] to the right, [2 node + 1] to the left, to itself from a leaf."""
    own, inner = np.arange(len(tree["feature"])), tree["feature"] >= 0
    return np.stack([np.where(inner, tree["right"], own), np.where(inner, tree["left"], own)], axis=1).reshape(-1)


def ends(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of every row; null and NaN go right."""
    n, flat, after = x.shape[1], np.ascontiguousarray(x).reshape(-1), tree["next"].astype(np.int64)
    split, cut = np.maximum(tree["feature"], 0).astype(np.int64) * n, tree["threshold"]
    out = np.zeros(n, dtype=np.int64)
    for a in range(0, n, WALK_ROWS):
        rows = np.arange(a, min(a + WALK_ROWS, n))
        at = np.zeros(len(rows), dtype=np.int64)
        for _ in range(int(tree["depth"].max())):
            place = split[at]
            place += rows
            less = flat[place] < cut[at]
            at <<= 1
            at += less
            at = after[at]
        out[rows] = at
    return out


def lengths(tree: dict[str, np.ndarray]) -> np.ndarray:
    """Path length of the rows that end in each node."""
    return tree["depth"] + expected_depth(tree["size"])


def unusual(paths: Iterable[np.ndarray], n_trees: int, scale: float) -> np.ndarray:
    """Scores from the path lengths of rows in each tree."""
    total = 0.0
    for own in paths:
        total = total + own
    return np.power(2.0, -total / n_trees / scale)


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The smallest value that at least `share` of the non-null values do not exceed, exactly."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = stage(running_totals(counts, F.col("v"), ["n"]), "quantile")
    n = upto.agg(F.max("cum_n")).first()[0]
    if n is None:
        return None
    return upto.where(F.col("cum_n") >= max(1, math.ceil(share * n - 1e-9))).agg(F.min("v")).first()[0]


def limit(scored: DataFrame, contamination: float | None = None) -> float | None:
    """The score that predicted outliers exceed: the contamination quantile, or 0.5."""
    return 0.5 if contamination is None else quantile(scored, "score", 1.0 - contamination)


def predict(scored: DataFrame, contamination: float | None = None) -> DataFrame:
    """Add prediction = 1 for scores above the contamination quantile, or above 0.5."""
    return predict_above(scored, limit(scored, contamination))


def predict_above(scored: DataFrame, least: float | None) -> DataFrame:
    return scored.withColumn("prediction", F.when(F.col("score") > F.lit(least), 1).otherwise(0))


def evaluate(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """One row `auc` against (row_id, label)."""
    return roc_auc(scored.join(labels.select(ID, "label"), ID))
