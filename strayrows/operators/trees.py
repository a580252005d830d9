"""Exact attributions of isolation forests.

`tree_shapley`: for a leaf, a set of known features keeps the leaf reachable with a probability that is a product over the
features split on the way, 0 or 1 where the feature is known and the share of rows that went that way where not. The sums over
all sets are coefficients of a polynomial with one factor per feature, so a leaf of u features costs u^2 and no set
is enumerated or sampled.

`split_importance`: how uneven the splits of each feature part the predicted outliers, against the other rows. Rows
add to numbers of the nodes they pass, a table of the forest's size, and leave no trace of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrows.functions.blocks import list_array, matrices
from strayrows.operators.attribute import to_long
from strayrows.operators.iforest import ForestDetector, ForestModel, ends, expected_depth, lengths, limit, unusual
from strayrows.operators.ranking import log_rank
from strayrows.spec import ID
from strayrows.staging import stage

#: Numbers of a chunk of leaves times rows.
CHUNK = 1 << 22


def leaves(tree: dict[str, np.ndarray]) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(path length, {feature: (lower, upper, share of rows)}) of every leaf of a tree."""
    todo = [(0, {})]
    while todo:
        node, box = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            yield float(tree["depth"][node] + expected_depth(tree["size"][node])), box
            continue
        lo, hi, share = box.get(f, (-np.inf, np.inf, 1.0))
        cut, size = float(tree["threshold"][node]), tree["size"]
        left, right = int(tree["left"][node]), int(tree["right"][node])
        todo.append((left, {**box, f: (lo, min(hi, cut), share * size[left] / size[node])}))
        todo.append((right, {**box, f: (max(lo, cut), hi, share * size[right] / size[node])}))


def _by_width(trees: Sequence[dict[str, np.ndarray]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Leaves of a forest by their number of features u: (value [L], feature, lower, upper, share, each [L, u])."""
    found: dict[int, list] = {}
    for tree in trees:
        for value, box in leaves(tree):
            found.setdefault(len(box), []).append((value, list(box), *zip(*box.values())) if box else (value, [], [], [], []))
    return {u: tuple(np.array(c) for c in zip(*own)) for u, own in found.items()}


def shapley_values(trees: Sequence[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """[feature, row]: Shapley values of the mean path length of [feature, row] vectors."""
    out = np.zeros(x.shape)
    n = max(x.shape[1], 1)
    for u, (value, feature, lower, upper, share) in _by_width(trees).items():
        if not u:
            continue
        weight = [factorial(k) * factorial(u - 1 - k) / factorial(u) for k in range(u)]
        step = max(1, CHUNK // (n * (u + 1)))
        for a in range(0, len(value), step):
            f, v, z = feature[a : a + step], value[a : a + step], share[a : a + step, :, None]
            own = x[f]  # [leaf, feature of the leaf, row]
            lo, hi = lower[a : a + step, :, None], upper[a : a + step, :, None]
            o = ~(own < lo) & ((own < hi) | (hi == np.inf))
            p = np.zeros((len(f), u + 1, x.shape[1]))
            p[:, 0] = 1.0
            for i in range(u):
                p[:, 1:] = p[:, 1:] * z[:, i, None] + p[:, :-1] * o[:, i, None]
                p[:, 0] *= z[:, i]
            for i in range(u):
                zi, oi = z[:, i], o[:, i]
                q = np.zeros_like(p[:, 0])
                known = np.zeros_like(q)  # weighted coefficients of the polynomial without factor i, where o is 1
                for k in range(u, 0, -1):
                    q = p[:, k] - zi * q
                    known += weight[k - 1] * q
                other = np.divide(sum(w * p[:, k] for k, w in enumerate(weight)), zi, out=np.zeros_like(q), where=np.broadcast_to(zi > 0, q.shape))
                np.add.at(out, f[:, i], v[:, None] * np.where(oi, (1 - zi) * known, -zi * other))
    return out / len(trees)


def expected_path(trees: Sequence[dict[str, np.ndarray]]) -> float:
    """Mean path length when nothing is known."""
    return float(sum(value * np.prod([s for _, _, s in box.values()]) for t in trees for value, box in leaves(t)) / len(trees))


def tree_shapley(model: ForestModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(row_id, feature, importance) of (row_id, x): exact Shapley values of the negated mean path length.

    What is not known follows the rows a tree was grown from. A row's values add up to the expected path length
    minus its own, so what makes it unusual is positive.
    """
    shared = model.shared()

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, x in matrices(batches):
            for a in range(0, x.shape[1], 4096):
                ids = columns[0].slice(a, 4096)
                yield pa.RecordBatch.from_arrays([ids, list_array(-shapley_values(shared.value, x[:, a : a + 4096]).T)], [ID, "imp"])

    found = rows.select(ID, "x").mapInArrow(attribute, f"{ID} bigint, imp array<double>")
    return to_long(found, "imp", features)


def path_lengths(model: ForestModel, rows: DataFrame) -> DataFrame:
    """(row_id, length, expected): a row's mean path length, and that of a row of which nothing is known."""
    shared = model.shared()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = expected_path(shared.value)
        for columns, x in matrices(batches):
            total = np.zeros(x.shape[1])
            for t in shared.value:
                total += lengths(t)[ends(t, x)]
            yield pa.RecordBatch.from_arrays(
                [columns[0], pa.array(total / len(shared.value)), pa.array(np.full(len(total), expected))], [ID, "length", "expected"]
            )

    return rows.select(ID, "x").mapInArrow(run, f"{ID} bigint, length double, expected double")


def node_visits(model: ForestModel, rows: DataFrame, limit: float | None = None) -> DataFrame:
    """(tree, node, prediction, n, inverse): rows of (row_id, x, prediction) through each node, and the sum of
    one over the depth of the leaf they end in.

    Without a column `prediction`, rows with a score above `limit` are the predicted outliers: one walk serves score and count. Only
    leaves are counted; a task adds them up the trees at its end.
    """
    shared, scale, known = model.shared(), float(expected_depth(model.sample)), "prediction" in rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        n = [np.zeros((2, len(t["feature"]))) for t in trees]
        far = [lengths(t) for t in trees]
        for columns, x in matrices(batches):
            leaf = [ends(t, x).astype(np.uint32) for t in trees]
            if known:
                kind = columns[1].to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                s = unusual((own[at] for own, at in zip(far, leaf)), len(trees), scale)
                kind = (s > (np.inf if limit is None else limit)).astype(np.int64)
            for own, at in zip(n, leaf):
                size = own.shape[1]
                own += np.bincount(kind * size + at, minlength=2 * size).reshape(2, size)
        for t, own in zip(trees, n):
            inverse = own / np.maximum(t["depth"], 1)
            for a in (own, inverse):
                _add_up(t, a)
            kind, node = np.nonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), t["tree"], np.int32)), pa.array(node.astype(np.int32)), pa.array(kind.astype(np.int32)),
                 pa.array(own[kind, node].astype(np.int64)), pa.array(inverse[kind, node])],
                ["tree", "node", "prediction", "n", "inverse"],
            )

    source = rows.select(ID, "prediction", "x") if known else rows.select(ID, "x")
    parts = source.mapInArrow(count, "tree int, node int, prediction int, n bigint, inverse double")
    return parts.groupBy("tree", "node", "prediction").agg(F.sum("n").alias("n"), F.sum("inverse").alias("inverse"))


def _add_up(tree: dict[str, np.ndarray], own: np.ndarray) -> None:
    """Numbers of leaves [kind, node] to those of all nodes, the deepest first."""
    inner = np.flatnonzero(tree["feature"] >= 0)
    for depth in range(int(tree["depth"].max()) - 1, -1, -1):
        at = inner[tree["depth"][inner] == depth]
        own[:, at] = own[:, tree["left"][at]] + own[:, tree["right"][at]]


def imbalance(n: Column, left: Column, right: Column) -> Column:
    """How uneven a split parts n rows: 0 if all go one way, else from 0.5 (halves) to 1 (one row against the rest)."""
    most = F.greatest(left, right) / n
    least_even, most_even = F.ceil(n / 2) / n, (n - 1) / n
    scaled = 0.5 + 0.5 * F.try_divide(most - least_even, most_even - least_even)
    return F.when((left == 0) | (right == 0), 0.0).otherwise(F.coalesce(scaled, most))


def split_importance(
    model: ForestModel, flagged: DataFrame, columns: Sequence[str], names: dict[str, str] | None = None, limit: float | None = None
) -> DataFrame:
    """(feature, importance) over all rows of (row_id, x, prediction), or of (row_id, x) with a `limit` of the score.

    A feature's weight in a set of rows is the mean, over rows and the nodes that split them by the feature, of the split's imbalance in
    that set over the row's path length; nodes that one row of the set passes are left out. The importance is the weight in the
    predicted outliers over that in the other rows (0 if either has none). `names` puts columns together to one feature.
    """
    visits = stage(node_visits(model, flagged, limit), "visits")
    inner = model.nodes.where("feature >= 0").select("tree", "node", "feature", "left", "right")
    child = lambda side: visits.select("tree", F.col("node").alias(side), "prediction", F.col("n").alias(f"n_{side}"))
    split = (
        visits.where("n > 1")
        .join(inner, ["tree", "node"])
        .join(child("left"), ["tree", "left", "prediction"], "left")
        .join(child("right"), ["tree", "right", "prediction"], "left")
    )
    own = F.array(*[F.lit((names or {}).get(c, c)) for c in columns])[F.col("feature")]
    uneven = imbalance(F.col("n"), F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0)))
    weights = split.groupBy(own.alias("feature"), "prediction").agg((F.sum(uneven * F.col("inverse")) / F.sum("n")).alias("w"))
    of = lambda p: F.max(F.when(F.col("prediction") == p, F.col("w")))
    return weights.groupBy("feature").agg(F.coalesce(F.try_divide(of(1), of(0)), F.lit(0.0)).alias("importance"))


def importance_over_runs(
    vectors: DataFrame, features: Sequence[str], seeds: Sequence[int], n_trees: int, sample: int, contamination: float | None = None
) -> DataFrame:
    """(run, feature, importance): split importance over all rows, of a forest for each seed."""
    out = None
    for seed in seeds:
        model = ForestDetector(n_trees, sample, seed).fit(vectors)
        scored = None if contamination is None else stage(model.score(vectors), "scores")
        part = split_importance(model, vectors.select(ID, "x"), features, limit=limit(scored, contamination))
        part = part.select(F.lit(seed).alias("run"), "feature", "importance")
        out = part if out is None else out.unionByName(part)
    return out


def ranked_importance(per_run: DataFrame) -> DataFrame:
    """(feature, score) by log rank over the runs."""
    return log_rank(per_run)
