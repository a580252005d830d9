"""Attribution, ranking metrics and grouping against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayrows.functions import planes
from strayrows.operators import attribute as A
from strayrows.operators import grouping as G
from strayrows.operators import metrics as M
from strayrows.operators import ranking as R
from strayrows.operators import shapley as SH
from strayrows.functions.prefix import running_totals
from strayrows.spec import FeatureSpec

SPEC = FeatureSpec(("a", "b", "c"), frozenset())


def graph(spark, imp, member):
    df = spark.createDataFrame(
        [(1, [float(v) for v in imp], [[float(v) for v in r] for r in member])],
        "row_id bigint, imp array<double>, member array<array<double>>",
    )
    return lambda f: np.array(df.select(f(F.col("imp"), F.col("member")).alias("v")).first()["v"])


MEMBER = np.array([[1, 0, 1, 1], [0, 1, 1, 0], [0, 0, 0, 0]])
IMP = np.array([2.0, 1.0, 4.0, 0.5])


def test_average_and_feature_without_projection(spark):
    got = graph(spark, IMP, MEMBER)(A.average)
    assert got == pytest.approx([6.5 / 3, 2.5, 0.0])


def test_random_walk_matches_matrix_form_and_sums_to_one(spark):
    weighted = (MEMBER * IMP).T
    col, row = weighted.sum(axis=0), weighted.T.sum(axis=0)
    a = weighted / np.where(col == 0, 1, col)
    b = weighted.T / np.where(row == 0, 1, row)
    q = (IMP / IMP.sum())[:, None]
    dr, pr = np.full((3, 1), 1 / 7), np.full((4, 1), 1 / 7)
    for _ in range(10):
        nd, np_ = 0.5 * b @ pr, 0.5 * a @ dr + 0.5 * q
        mass = nd.sum() + np_.sum()
        dr, pr = nd / mass, np_ / mass
    got = graph(spark, IMP, MEMBER)(A.random_walk)
    assert got == pytest.approx((dr / dr.sum()).ravel())
    assert got.sum() == pytest.approx(1.0)


def test_hits_match_matrix_form(spark):
    r = MEMBER.T.astype(float)
    s = r.T.sum(axis=0)
    b = r.T / np.where(s == 0, 1, s)
    q = (IMP / np.linalg.norm(IMP))[:, None]
    pr = q.copy()
    for _ in range(20):
        dr = b @ pr
        dr /= np.linalg.norm(dr)
        pr = 0.5 * r @ dr + 0.5 * q
        pr /= np.linalg.norm(pr)
    assert graph(spark, IMP, MEMBER)(A.hits) == pytest.approx(dr.ravel())
    pr = np.full((4, 1), 0.1)
    for _ in range(20):
        dr = b @ pr
        dr /= np.linalg.norm(dr)
        pr = b.T @ dr
        pr /= np.linalg.norm(pr)
    assert graph(spark, IMP, MEMBER)(A.structure_hits) == pytest.approx(dr.ravel())


def test_dimension_importance_by_hand(spark):
    rows = [
        (1, 0, 1, 0, 5.0), (1, 0, 2, 1, 3.0), (1, 0, 3, 0, 3.0),
        (1, 1, 1, 0, 2.0), (1, 1, 2, 0, 4.0), (1, 1, 3, 1, 6.0),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, chain int, depth int, split int, v double")
    got = A.dimension_importance(df, 3).first()["imp"]
    # chain 0 stops at depth 2 (first of two minima), chain 1 at depth 1
    assert got == pytest.approx([(1.0 + 4.0) / 3, 3.0 / 2, 0.0])


def test_membership_uses_each_rows_own_category(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 1.0, "y")], "row_id bigint, n double, c string")
    spec = FeatureSpec.from_schema(df.schema)
    m = {r["row_id"]: r["member"] for r in A.membership(df, spec, 40).collect()}
    assert m[1][0] == m[2][0] and m[1][1] != m[2][1]


def test_fold_one_hot_per_row(spark):
    df = spark.createDataFrame(
        [(1, "c=x", 1.0, 0.7), (1, "c=y", 0.0, 0.9), (1, "n", 1.0, 0.2),
         (2, "c=x", 0.0, 0.7), (2, "c=y", 1.0, 0.4), (2, "n", 1.0, 0.1)],
        "row_id bigint, column string, active double, importance double",
    )
    got = {(r[0], r[1]): r[2] for r in A.fold_one_hot(df, {"c=x": "c", "c=y": "c"}).collect()}
    assert got == pytest.approx({(1, "c"): 0.7, (1, "n"): 0.2, (2, "c"): 0.4, (2, "n"): 0.1})


def test_ranking_metrics_with_ties(spark):
    score = [0.9, 0.8, 0.8, 0.8, 0.3, 0.3, 0.1]
    label = [1, 1, 0, 1, 0, 1, 0]
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(zip(score, label))], "row_id bigint, score double, label int")
    pos = [s for s, y in zip(score, label) if y]
    neg = [s for s, y in zip(score, label) if not y]
    auc = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])
    assert M.roc_auc(df).first()["auc"] == pytest.approx(auc)
    ap = (1 / 4) * 1.0 + (2 / 4) * (3 / 4) + (1 / 4) * (4 / 6)
    assert M.average_precision(df).first()["ap"] == pytest.approx(ap)
    assert M.precision_at_k(df, 2).first()[0] == 1.0


def test_running_totals_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("key"), F.lit(2).alias("v"))
    got = running_totals(df, F.col("key"), ["v"], 16).collect()
    assert all(r["cum_v"] == 2 * (r["key"] + 1) for r in got)


def test_log_rank_and_rank_share(spark):
    df = spark.createDataFrame(
        [(0, "a", 3.0), (0, "b", 2.0), (0, "c", 0.0), (1, "a", 1.0), (1, "b", 5.0), (1, "c", 0.0)],
        "run int, feature string, importance double",
    )
    got = {r["feature"]: r["score"] for r in R.log_rank(df).collect()}
    second = 1 - math.log(2) / math.log(3)
    assert got == pytest.approx({"a": 1 + second, "b": 1 + second, "c": 0.0})
    shares = R.rank_share(df.withColumnRenamed("run", "row_id")).collect()
    assert {(r["rank"], r["feature"]): r["share"] for r in shares} == {
        (1, "a"): 0.5, (1, "b"): 0.5, (2, "a"): 0.5, (2, "b"): 0.5, (3, "c"): 1.0,
    }


def _points(spark, n=150, dims=4):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dims)) + (np.arange(n) % 3)[:, None] * 2
    df = spark.createDataFrame([(i * 3, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, v array<double>")
    return x, df


def test_silhouette_over_blocks_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", 20)
    monkeypatch.setattr(G, "OTHER_ROWS", 50)
    x, df = _points(spark)
    labels = np.arange(len(x)) % 3
    labels[0] = 9  # a cluster of one row counts as 0
    clusters = spark.createDataFrame(
        [(3, i * 3, int(c)) for i, c in enumerate(labels)] + [(1, i * 3, 0) for i in range(len(x))],
        "k int, row_id bigint, cluster_id int",
    )
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    values = []
    for i, c in enumerate(labels):
        own = [j for j in range(len(x)) if labels[j] == c and j != i]
        if not own:
            values.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        values.append((b - a) / max(a, b))
    got = {r["k"]: r["silhouette"] for r in G.silhouette(G.cluster_distances(df, clusters)).collect()}
    assert got == {3: pytest.approx(np.mean(values))}


def test_copies_of_a_row_add_no_pairs(spark, monkeypatch):
    """200 rows at 8 places: 8 places meet, and every row's means are those over all 200."""
    monkeypatch.setattr(G, "BLOCK_ROWS", 2)
    monkeypatch.setattr(G, "OTHER_ROWS", 3)
    x = np.random.default_rng(4).normal(size=(8, 9))[np.arange(200) % 8]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, v array<double>")
    label = np.arange(200) % 3
    rows = [(3, i, int(c)) for i, c in enumerate(label)] + [(2, i, i // 199) for i in range(200)]
    clusters = spark.createDataFrame(rows, "k int, row_id bigint, cluster_id int")
    held = clusters.groupBy("row_id").agg(F.collect_list(F.struct("k", "cluster_id")).alias("own"))
    assert G.places_of(df.select("row_id", F.col("v").alias("at")).join(held, "row_id")).count() == 8
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    found = G.cluster_distances(df, clusters).collect()
    assert len(found) == 200 * 5
    for r in found:
        own = label if r["k"] == 3 else np.arange(200) // 199
        others = [j for j in np.flatnonzero(own == r["other_id"]) if j != r["row_id"]]
        assert (r["cluster_id"], r["n"]) == (own[r["row_id"]], len(others))
        assert r["mean_distance"] == (pytest.approx(d[r["row_id"], others].mean(), abs=1e-12) if others else None)


def _brute_sums(places, weights):
    total = np.zeros((len(places), weights.shape[1]))
    planes.add(total, places, places, weights)
    return total


@pytest.mark.parametrize("kind", ["even", "skewed", "one line", "few rows high", "far from 0"])
def test_sums_over_boxes_equal_sums_over_pairs(kind):
    rng = np.random.default_rng(3)
    x = rng.random((6000, 2))
    if kind == "skewed":
        x = np.exp(6 * rng.normal(size=x.shape))
    elif kind == "one line":
        x[:, 1] = 0.25
    elif kind == "few rows high":
        x[:, 1] = rng.integers(1, 9, len(x))
    elif kind == "far from 0":
        x += 1e6
    x = np.unique(x, axis=0)
    weights = rng.integers(0, 4, (len(x), 3)).astype(float)
    order, boxes = planes.tree(x)
    found = planes.sums(x[order], weights[order], boxes, [])
    assert np.allclose(found, _brute_sums(x[order], weights[order]), rtol=1e-11, atol=0)


def test_sums_over_boxes_meet_few_pairs(monkeypatch):
    """Twice the places meet little more than twice the pairs, far fewer than all."""
    met, add = [], planes.add
    monkeypatch.setattr(planes, "add", lambda total, a, b, w: (met.append(len(a) * len(b)), add(total, a, b, w)))
    pairs = []
    for n in (20_000, 40_000):
        met.clear()
        x = np.random.default_rng(2).random((n, 2))
        order, boxes = planes.tree(x)
        planes.sums(x[order], np.ones((n, 1)), boxes, [])
        pairs.append(sum(met))
    assert pairs[1] < 2.6 * pairs[0] and pairs[1] < 40_000**2 / 3


@pytest.mark.parametrize("dims", [1, 2])
def test_many_places_are_summed_by_regions(spark, monkeypatch, dims):
    """Several regions of several leaves: every row's means equal those over all pairs, copies counted."""
    monkeypatch.setattr(G, "MANY_PLACES", 100)
    monkeypatch.setattr(G, "REGION_ROWS", 300)
    monkeypatch.setattr(G, "block_sums", None)
    rng = np.random.default_rng(8)
    x = np.exp(2 * rng.normal(size=(2500, dims)))
    x = np.concatenate([x, x[:200]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, v array<double>")
    label = {3: rng.integers(0, 3, len(x)), 2: (np.arange(len(x)) == 7).astype(int)}
    rows = [(k, i, int(c)) for k, own in label.items() for i, c in enumerate(own)]
    found = G.cluster_distances(df, spark.createDataFrame(rows, "k int, row_id bigint, cluster_id int")).collect()
    assert len(found) == len(x) * 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for k, own in label.items():
        sums = np.stack([d[:, own == c].sum(axis=1) for c in range(k)], axis=1)
        size = np.bincount(own, minlength=k)
        for r in (r for r in found if r["k"] == k):
            c = r["other_id"]
            n = size[c] - (own[r["row_id"]] == c)
            assert (r["cluster_id"], r["n"]) == (own[r["row_id"]], n)
            assert r["mean_distance"] == (pytest.approx(sums[r["row_id"], c] / n, rel=1e-11) if n else None)


def test_distances_of_near_rows_far_from_the_origin():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(50, 64)) + 1e4
    b = np.concatenate([a[:20], a[:20] + 1e-7, rng.normal(size=(30, 64)) + 1e4])
    exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert np.allclose(G.distances(a, b), exact, rtol=1e-9, atol=0)
    assert (np.diag(G.distances(a, b)[:20, :20]) == 0).all()


def test_embedding_is_centred_and_keeps_planar_distances(spark):
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 5)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(flat)], "row_id bigint, v array<double>")
    got = np.array([(r["x"], r["y"]) for r in G.embed_2d(df).orderBy("row_id").collect()])
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    dist = lambda p: np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert np.allclose(dist(got), dist(flat), atol=1e-6)


def test_sweep_ids_and_best_k(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    p = centres[np.arange(90) % 3] + rng.normal(size=(90, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "row_id bigint, x double, y double")
    sweep = G.cluster_sweep(df, 6).cache()
    assert all(r["cluster_id"] < r["k"] for r in sweep.collect())
    assert {r["k"]: r["n"] for r in sweep.groupBy("k").agg(F.count("*").alias("n")).collect()} == {k: 90 for k in range(1, 6)}
    v = df.select("row_id", F.array("x", "y").alias("v"))
    assert G.best_k(G.silhouette(G.cluster_distances(v, sweep))).first()["k"] == 3


def test_shapley_of_an_additive_score(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(30, 3)))]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>")
    score = lambda d: d.select("row_id", (2 * F.col("x")[0] - F.col("x")[1]).alias("score"))
    got = SH.shapley(df.where("row_id < 2"), df, score, ("a", "b", "c"), 6, 1, seed=1)
    by = {(r["row_id"], r["feature"]): r["importance"] for r in got.collect()}
    base = df.orderBy(F.xxhash64("row_id", F.lit(1)), "row_id").first()["x"]
    for i in (0, 1):
        x = rows[i][1]
        assert by[i, "a"] == pytest.approx(2 * (x[0] - base[0]))
        assert by[i, "b"] == pytest.approx(base[1] - x[1])
        assert by[i, "c"] == pytest.approx(0.0)
