"""Forest, injection and streams."""

import itertools
import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayrows.operators import chains as C
from strayrows.operators import countmin as CM
from strayrows.operators import inject as N
from strayrows.operators import iforest as I
from strayrows.operators import trees as TR
from strayrows.plans import pipeline
from strayrows.plans.mixed_forest import MixedForest, categories_of, importance_of_runs
from strayrows.spec import FeatureSpec
from strayrows.streaming import blocks as B
from strayrows.streaming import updates as U

VECTORS = "row_id bigint, x array<double>"


@pytest.fixture(scope="module")
def cloud(spark):
    """400 central rows and 8 far away in the second dimension."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 3)))]
    rows += [(1000 + i, [0.0, 15.0 + i, 0.0]) for i in range(8)]
    df = spark.createDataFrame(rows, VECTORS).cache()
    df.count()
    return df


def test_expected_depth():
    assert list(I.expected_depth([0, 1, 2])) == [0.0, 0.0, 1.0]
    assert I.expected_depth(256) == pytest.approx(10.24, abs=0.01)


def test_samples_are_bounded_and_repeatable(spark, cloud):
    a = I.tree_samples(cloud, 408, 10, 64, 1)
    assert all(r["count"] == 64 for r in a.groupBy("tree").count().collect())
    key = lambda d: sorted((r["tree"], r["row_id"]) for r in d.collect())
    assert key(a) == key(I.tree_samples(cloud.repartition(5), 408, 10, 64, 1))
    large = I.tree_samples(spark.range(200_000).select(F.col("id").alias("row_id"), F.array(F.lit(0.0)).alias("x")), 200_000, 10, 64, 1)
    assert all(r["count"] == 64 for r in large.groupBy("tree").count().collect())


def test_forest_finds_and_explains_far_rows(spark, cloud):
    model = I.ForestDetector(50, 128, 2).fit(cloud)
    scores = model.score(cloud).cache()
    assert scores.where("score <= 0 or score >= 1").count() == 0
    # a normal row at the edge of the cloud may rank among the far ones
    assert set(range(1000, 1008)) <= {r["row_id"] for r in C.top_k(scores, 20).collect()}
    labels = cloud.select("row_id", (F.col("row_id") >= 1000).cast("int").alias("label"))
    assert I.evaluate(scores, labels).first()["auc"] > 0.97
    assert I.predict(scores, 0.05).where("prediction = 1").count() == pytest.approx(20, abs=1)
    why = model.path_importance(cloud.where("row_id >= 1000"), ("a", "b", "c"))
    mean = {r[0]: r[1] for r in why.groupBy("feature").avg("importance").collect()}
    assert mean["b"] > mean["a"] and mean["b"] > mean["c"]
    ranks = TR.ranked_importance(TR.importance_over_runs(cloud, ("a", "b", "c"), (0, 1), 20, 64)).collect()
    assert {r["feature"] for r in ranks} == {"a", "b", "c"}


def subset_value(tree, x, known, node=0):
    """Mean path length of a row of which only the features `known` count."""
    f = tree["feature"][node]
    if f < 0:
        return float(tree["depth"][node] + I.expected_depth(tree["size"][node]))
    left, right = tree["left"][node], tree["right"][node]
    if f in known:
        return subset_value(tree, x, known, left if x[f] < tree["threshold"][node] else right)
    share = tree["size"][left] / tree["size"][node]
    return share * subset_value(tree, x, known, left) + (1 - share) * subset_value(tree, x, known, right)


def test_tree_shapley_equals_all_subsets(spark, cloud):
    model = I.ForestDetector(6, 40, 2).fit(cloud)
    trees, rows = model.shared().value, cloud.where("row_id % 50 = 3 or row_id >= 1005")
    x = {r["row_id"]: np.array(r["x"]) for r in rows.collect()}
    got = {(r["row_id"], r["feature"]): r["importance"] for r in TR.tree_shapley(model, rows, "abc").collect()}
    names = range(3)
    for i, row in x.items():
        mean = lambda known: sum(subset_value(t, row, known) for t in trees) / len(trees)  # noqa: E731, B023
        for f in names:
            others, value = [g for g in names if g != f], 0.0
            for size in range(3):
                for known in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / 6
                    value += weight * (mean({*known, f}) - mean(set(known)))
            assert got[i, "abc"[f]] == pytest.approx(-value, abs=1e-9)
    lengths = {r["row_id"]: (r["length"], r["expected"]) for r in TR.path_lengths(model, rows).collect()}
    for i, (length, expected) in lengths.items():
        assert sum(got[i, f] for f in "abc") == pytest.approx(expected - length, abs=1e-9)


def test_tree_shapley_of_missing_values_and_empty_sides():
    """A split that no row took one way, and NaN, which goes right everywhere."""
    tree = {
        "tree": 0, "feature": np.array([0, 1, -1, -1, 0, -1, -1]), "threshold": np.array([1.0, 0.0, 0, 0, 2.0, 0, 0]),
        "left": np.array([1, 2, -1, -1, 5, -1, -1]), "right": np.array([4, 3, -1, -1, 6, -1, -1]),
        "size": np.array([8, 4, 0, 4, 4, 3, 1]), "depth": np.array([0, 1, 2, 2, 1, 2, 2]),
    }
    for row in ([0.0, -1.0], [np.nan, np.nan], [1.5, 3.0], [9.0, -2.0], [0.5, np.nan]):
        x = np.array(row)
        v = {k: subset_value(tree, x, set(k)) for k in ((), (0,), (1,), (0, 1))}
        want = [(v[0,] - v[()] + v[0, 1] - v[1,]) / 2, (v[1,] - v[()] + v[0, 1] - v[0,]) / 2]
        assert TR.shapley_values([tree], x[:, None])[:, 0] == pytest.approx(want)


def test_split_importance_equals_row_by_row(spark, cloud):
    model = I.ForestDetector(7, 30, 4).fit(cloud)
    flagged = cloud.withColumn("prediction", (F.col("row_id") >= 1000).cast("int")).repartition(3)
    weight = {}
    for kind in (0, 1):
        x = np.array([r["x"] for r in flagged.where(f"prediction = {kind}").collect()])
        total, times = np.zeros(3), np.zeros(3)
        for t in model.shared().value:
            paths = []
            for row in x:
                path = [0]
                while t["feature"][path[-1]] >= 0:
                    at = path[-1]
                    path.append(t["left"][at] if row[t["feature"][at]] < t["threshold"][at] else t["right"][at])
                paths.append(path)
            n = Counter(node for p in paths for node in p)
            for p in paths:
                for at in p[:-1]:
                    if n[at] < 2:
                        continue
                    sides = n[t["left"][at]], n[t["right"][at]]
                    lo, hi, most = math.ceil(n[at] / 2) / n[at], (n[at] - 1) / n[at], max(sides) / n[at]
                    uneven = 0 if min(sides) == 0 else 0.5 + 0.5 * (most - lo) / (hi - lo) if hi > lo else most
                    total[t["feature"][at]] += uneven / (len(p) - 1)
                    times[t["feature"][at]] += 1
        weight[kind] = total / times
    got = {r["feature"]: r["importance"] for r in TR.split_importance(model, flagged, "abc").collect()}
    assert [got[f] for f in "abc"] == pytest.approx(list(weight[1] / weight[0]))
    folded = TR.split_importance(model, flagged, "abc", {"a": "ab", "b": "ab"}).collect()
    assert {r["feature"] for r in folded} == {"ab", "c"}


def test_mixture_density_integrates_to_one(spark):
    m = N.Mixture((0.3, 0.7), (0.0, 5.0), (1.0, 0.5), 0.0, 1.0)
    grid = spark.range(-1000, 2000).select((F.col("id") / 100).alias("x"))
    total = grid.agg(F.sum(F.exp(m.log_density(F.col("x")))) / 100).first()[0]
    assert total == pytest.approx(1.0, abs=1e-6)


def test_injected_rows_have_known_causes(spark):
    rng = np.random.default_rng(1)
    rows = [
        (i, float(50 + 5 * rng.normal()), float(100 + 10 * rng.normal()), "rare" if i % 100 == 7 else "usual")
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, c string")
    spec = FeatureSpec.from_schema(df.schema)
    groups = (N.OutlierGroup(("a", "c"), "global"), N.OutlierGroup(("b",), "local"))
    table, truth = N.inject(df, spec, groups, 300, 3, 4, 0.05, max_components=2, max_iter=20, seed=3)
    table = table.cache()
    assert table.where("label = 0").count() == 300
    outliers = table.where("label = 1").collect()
    assert len(outliers) == 24 and len({r["row_id"] for r in outliers}) == 24
    assert all(r["row_id"] > 499 for r in outliers)
    why = {}
    for r in truth.collect():
        why.setdefault(r["row_id"], {})[r["feature"]] = r["importance"]
    for r in outliers:
        causes = {f for f, v in why[r["row_id"]].items() if v > 0}
        assert causes in ({"a", "c"}, {"b"})
        if "c" in causes:
            assert r["c"] == "rare" and not 35 < r["a"] < 65
    again, _ = N.inject(df.repartition(3), spec, groups, 300, 3, 4, 0.05, max_components=2, max_iter=20, seed=3)
    ids = lambda t: sorted(r["row_id"] for r in t.where("label = 1").collect())
    assert ids(again) == ids(table)


def test_rare_category(spark):
    df = spark.createDataFrame([(v,) for v in "aabbbcc"], "c string")
    assert N.rare_category(N.category_shares(df, "c")).first()["value"] == "a"


def event_files(spark, cloud, tmp_path):
    cloud.repartitionByRange(4, "row_id").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(VECTORS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_counts_equal_batch_counts(spark, cloud, tmp_path):
    plan = C.ChainPlan.draw(3, 3, 4, 1)
    model = C.fit_plan(cloud, plan)
    stream = event_files(spark, cloud, tmp_path)
    counts = U.streaming_sketch(stream, plan, model.deltas)
    U.write_latest(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda d: sorted((r["chain"], r["depth"], tuple(r["bin"]), r["cnt"]) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(model.sketch)


def test_bounded_stream_state(spark, cloud, tmp_path):
    plan, shape = C.ChainPlan.draw(3, 3, 4, 1), CM.SketchShape(2, 6)
    deltas = C.half_ranges(C.ranges(cloud, 3))
    cells = U.streaming_cells(event_files(spark, cloud, tmp_path), plan, deltas, shape)
    U.write_latest(cells, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda d: sorted((r["cell"], r["cnt"]) for r in d.collect())
    got = key(spark.read.parquet(str(tmp_path / "out")))
    assert got == key(CM.count_cells(cloud, plan, deltas, shape))
    assert len(got) <= 3 * 4 * 2 * 64


def test_scores_before_counting_and_final_counts(spark, cloud, tmp_path):
    shape = CM.SketchShape(2, 12)
    first = cloud.where("row_id < 200")
    start = CM.CountMinDetector(3, 10, 6, 1, shape).fit(first)
    later = cloud.where("row_id >= 200")
    stream = event_files(spark, later, tmp_path)
    U.score_and_count(stream, start, str(tmp_path / "run"), str(tmp_path / "cp")).awaitTermination()
    scores = U.read_scores(spark, str(tmp_path / "run"))
    assert scores.count() == later.count() and scores.select("epoch").distinct().count() > 1
    epoch0 = scores.where("epoch = 0")
    rows = cloud.join(epoch0, "row_id", "left_semi")
    key = lambda d: {r["row_id"]: r["score"] for r in d.collect()}
    assert key(epoch0) == key(start.score(rows))
    cells = lambda d: {r["cell"]: r["cnt"] for r in d.collect()}
    last = scores.agg(F.max("epoch")).first()[0]
    after = U.counters_after(spark, str(tmp_path / "run"), start.plan, shape, last)
    assert cells(after) == cells(start.update(later).cells)


def test_repeated_batches_change_nothing_and_the_log_stays_small(spark, cloud, tmp_path):
    shape = CM.SketchShape(2, 6)
    parts = [cloud.where(f"row_id % 13 = {i}") for i in range(13)]
    start = CM.CountMinDetector(3, 4, 5, 1, shape).fit(parts[0])
    path = str(tmp_path / "run")
    step = U.ScoringStep(spark, start, path, every=3)
    cells = lambda d: {r["cell"]: r["cnt"] for r in d.collect()}
    model, folders = start, set()
    for epoch, part in enumerate(parts[1:]):
        for _ in range(2 if epoch % 2 or epoch == 8 else 1):  # 2, 5, 8 and 11 end with a new base
            step(part, epoch)
            got = spark.read.parquet(f"{path}/scores/epoch={epoch}")
            assert {r["row_id"]: r["score"] for r in got.collect()} == {r["row_id"]: r["score"] for r in model.score(part).collect()}
        model = model.update(part)
        assert cells(U.counters_after(spark, path, start.plan, shape, epoch)) == cells(model.cells)
        counters = tmp_path / "run" / "counters"
        folders.add((len(list((counters / "epochs").iterdir())), len(list((counters / "bases").iterdir())), len(list((counters / "manifest").iterdir()))))
    assert max(f[0] for f in folders) <= 6 and max(f[1] for f in folders) <= 3 and max(f[2] for f in folders) <= 4
    assert not list((tmp_path / "run" / "batch").iterdir())


def test_partitioned_counters_score_a_stream(spark, cloud, tmp_path):
    shape = CM.SketchShape(2, 6)
    first, later = cloud.where("row_id < 200"), cloud.where("row_id >= 200")
    whole = CM.CountMinDetector(3, 4, 5, 1, shape).fit(first)
    cut = CM.CountMinDetector(3, 4, 5, 1, shape, block_bytes=1).fit(first)
    a, b = U.ScoringStep(spark, whole, str(tmp_path / "a")), U.ScoringStep(spark, cut, str(tmp_path / "b"), count_first=True)
    a(later, 0)
    b(later, 0)
    read = lambda p: {r["row_id"]: r["score"] for r in U.read_scores(spark, str(tmp_path / p)).collect()}
    assert read("a") == {r["row_id"]: r["score"] for r in whole.score(later).collect()}
    assert read("b") == {r["row_id"]: r["score"] for r in whole.update(later).score(later).collect()}


def test_state_rows_stay_constant(spark, cloud, tmp_path):
    plan, shape = C.ChainPlan.draw(3, 3, 4, 1), CM.SketchShape(2, 13)
    deltas = C.half_ranges(C.ranges(cloud, 3))
    B.use_rocksdb(spark)
    stream = event_files(spark, cloud, tmp_path)
    query = U.write_blocks(B.running_blocks(stream, plan, deltas, shape), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    blocks = 3 * 4 * 2 * (1 << 13) // B.BLOCK
    assert len(rows) >= 3 and set(rows) == {blocks}
    got = {r["cell"]: r["cnt"] for r in B.opened_blocks(U.latest_blocks(spark, str(tmp_path / "out"))).collect()}
    want = CM.count_cells(cloud, plan, deltas, shape)
    assert got == {r["cell"]: r["cnt"] for r in want.collect()}
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 2


def test_whole_pipeline(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(10 + 5 * i, float(rng.normal()), float(rng.normal()), "ab"[i % 2], 0) for i in range(300)]
    rows += [(5000 + i, 12.0 + 0.1 * i, float(rng.normal()), "a", 1) for i in range(10)]
    rows += [(6000 + i, float(rng.normal()), -14.0 - 0.1 * i, "c", 1) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id bigint, u double, v double, w string, y int")
    spec = FeatureSpec.from_schema(df.schema, label="y")
    p = pipeline.Parameters(
        projdim=12, nchains=15, depth=6, topk=20, cluster_num=4, top_features=3, use_label=True,
        pairs=pipeline.L.PairDetector(6, 6, 6),
    )
    found = pipeline.detect(df, spec, p)
    assert found.auc.first()["auc"] > 0.95
    assert found.outliers.count() == 20
    sums = found.attribution.groupBy("row_id").agg(F.sum("importance").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    assert found.scores.where("score_norm < 0 or score_norm > 1").count() == 0
    rules = pipeline.describe(df, spec, found, p).cache()
    assert rules.where("coverage < 0.05 or purity <= 0.05").count() == 0
    assert rules.select("k", "cluster_id").distinct().count() >= 2
    pairs = pipeline.focus_pairs(df, spec, found, p, saved=str(tmp_path / "pairs"))
    assert pairs.totals.agg(F.max("budget")).first()[0] == 5
    per_cluster = found.clusters.groupBy("k", "cluster_id").count().collect()
    explained = {(r["k"], r["cluster_id"]): r["n"] for r in pairs.totals.where("budget = 5").groupBy("k", "cluster_id").agg(F.sum("n").alias("n")).collect()}
    assert explained == {(r["k"], r["cluster_id"]): r["count"] for r in per_cluster}
    pipeline.save(df, spec, found, rules, str(tmp_path / "out"))
    wide = spark.read.parquet(str(tmp_path / "out/result"))
    assert wide.count() == 20
    assert {"x", "y", "1 clusters", "3 clusters", "optimal cluster", "u_ex", "w_ex", "w", "anomaly_scores", "label"} <= set(wide.columns)
    assert spark.read.parquet(str(tmp_path / "out/normal")).count() == 300


def test_pipeline_with_bounded_counters(spark, cloud):
    df = cloud.select("row_id", *[F.col("x")[i].alias(f"f{i}") for i in range(3)])
    spec = FeatureSpec.from_schema(df.schema)
    p = pipeline.Parameters(projdim=None, nchains=100, depth=10, topk=20, cluster_num=3)
    found = pipeline.detect(df, spec, p)
    assert set(range(1000, 1008)) <= {r["row_id"] for r in found.outliers.collect()}
    with pytest.raises(ValueError):
        pipeline.detect(df, spec, pipeline.Parameters(projdim=None, detector="other"))


def mixed_rows(spark):
    """300 usual rows and ten with a rare category and an extreme number."""
    rows = [(i, float(i % 17), "ab"[i % 2], "xyz"[i % 3], 0) for i in range(300)]
    rows += [(1000 + i, 90.0 + i, "odd", "x", 1) for i in range(10)]
    return spark.createDataFrame(rows, "row_id bigint, v double, c string, d string, label int")


def test_mixed_forest_finds_and_explains_odd_rows(spark):
    df = mixed_rows(spark)
    spec = FeatureSpec(("v", "c", "d"), frozenset({"c", "d"}))
    forest = MixedForest.fit(df, spec, I.ForestDetector(64, 128, 3))
    assert forest.columns == ["c=a", "c=b", "c=odd", "d=x", "d=y", "d=z", "v"]
    top = {r["row_id"] for r in C.top_k(forest.score(df), 10).collect()}
    assert len(top & set(range(1000, 1010))) >= 9
    imp = {(r["row_id"], r["feature"]): r["importance"] for r in forest.attribution(df.where("row_id = 1003")).collect()}
    assert set(imp) == {(1003, f) for f in spec.features}
    assert imp[1003, "v"] > imp[1003, "d"]
    other = spark.createDataFrame([(1, None, "new", None)], "row_id bigint, v double, c string, d string")
    assert forest.vectors(other).first()["x"] == [0.0] * 7
    with pytest.raises(ValueError):
        categories_of(df, spec, most=3)


def test_importance_of_runs_has_the_mean_f1(spark):
    spec = FeatureSpec(("v", "c", "d"), frozenset({"c", "d"}))
    rows = importance_of_runs(mixed_rows(spark), spec, (0, 1), 32, 128, 10 / 310).collect()
    score = {r["feature"]: r["score"] for r in rows}
    assert set(score) == set(spec.features) and score["d"] <= max(score.values())
    assert {r["mean_f1"] for r in rows} == {rows[0]["mean_f1"]} and rows[0]["mean_f1"] >= 0.8


def test_exact_quantile_of_contamination(spark):
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(100)], "row_id bigint, score double")
    assert I.quantile(df, "score", 0.9) == 44.0 and I.quantile(df, "score", 0.0) == 0.0
    assert I.quantile(df.limit(0), "score", 0.5) is None
    assert I.predict(df, 0.1).where("prediction = 1").count() == 10


def test_draws_come_from_the_unlikely_region():
    m = N.Mixture((0.5, 0.5), (0.0, 10.0), (1.0, 1.0), -3.0, 13.0)
    m = replace(m, min_log=float(m.log_at(np.array([-2.5]))[0]))
    intervals = m.unlikely(-9.5, 32.5)
    assert len(intervals) == 3
    for a, b in intervals:
        assert (m.log_at(np.linspace(a, b, 50)) < m.min_log + 1e-9).all()
    inside = [x for x in np.linspace(-9.5, 32.5, 999) if any(a <= x <= b for a, b in intervals)]
    assert len(inside) == int((m.log_at(np.linspace(-9.5, 32.5, 999)) < m.min_log).sum())


def test_every_draw_is_accepted(spark):
    m = N.Mixture((1.0,), (5.0,), (1.0,), 2.0, 8.0)
    m = replace(m, min_log=float(m.log_at(np.array([2.0]))[0]))
    ids = spark.range(500).select(F.col("id").alias("row_id"))
    for make in (N.local_value, N.global_value):
        x = np.array([r[0] for r in ids.select(make(m, F.col("row_id"), 1, "f", True)).collect()])
        assert (m.log_at(x) < m.min_log).all() and (x > 0).all() and len(np.unique(x)) > 400


def test_mixtures_from_histograms(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(20, 2, 1000)])
    df = spark.createDataFrame([(float(v), 1.0) for v in x] + [(None, 1.0)], "x double, same double")
    found = N.fit_mixtures(df, ["x", "same"], 4)
    means = sorted(zip(found["x"].means, found["x"].weights), key=lambda p: -p[1])
    assert means[0][0] == pytest.approx(0, abs=0.2) and means[0][1] == pytest.approx(0.75, abs=0.05)
    assert found["same"].means == (1.0,)


@pytest.mark.parametrize("far", [1e4, 1e12, -1e9])
def test_mixtures_beside_an_extreme_value(spark, far):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(20, 2, 1000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(far,), (float("nan"),), (None,)], "x double")
    found = N.fit_mixture(df, "x", 5)
    body = sorted((w, m, s) for w, m, s in zip(found.weights, found.means, found.sds) if abs(m) < 100)
    weight = lambda lo, hi: sum(w for w, m, _ in body if lo < m < hi)
    assert weight(-4, 6) == pytest.approx(0.75, abs=0.03) and weight(12, 28) == pytest.approx(0.25, abs=0.03)
    assert all(s < 4 for w, m, s in body if w > 0.01)
    assert max(abs(m) for m in found.means) == pytest.approx(abs(far), rel=1e-6)


def test_a_saved_detection_goes_on_after_loading(spark, cloud, tmp_path):
    df = cloud.select("row_id", *[F.col("x")[i].alias(f"f{i}") for i in range(3)])
    spec = FeatureSpec.from_schema(df.schema)
    p = pipeline.Parameters(projdim=None, nchains=20, depth=6, topk=12, cluster_num=3, top_features=2, shape=CM.SketchShape(bits=8))
    found = pipeline.detect(df, spec, p)
    rules = pipeline.describe(df, spec, found, p)
    pipeline.save(df, spec, found, rules, str(tmp_path / "saved"))
    again = pipeline.load(spark, str(tmp_path / "saved"))
    key = lambda t: sorted(map(repr, t.collect()))
    assert key(pipeline.joined(df, spec, again)) == key(pipeline.joined(df, spec, found))
    assert pipeline.load_rules(spark, str(tmp_path / "saved")).count() == rules.count()
    assert pipeline.focus(again, 2).count() == pipeline.focus(found, 2).count()


def test_density_works_out_its_parts_once(spark):
    """The powers of a mixture's Gaussians stand once in the expression, not once for each of its parts."""
    m = N.Mixture((0.5, 0.5), (0.0, 3.0), (1.0, 2.0), -5.0, 9.0)
    density = m.log_density(F.col("x"))
    assert density._jc.toString().upper().count("POW") <= 1
    rows = spark.createDataFrame([(v,) for v in (-4.0, 0.0, 2.5, 60.0)], "x double").select("x", density.alias("d")).collect()
    assert [r["d"] for r in rows] == pytest.approx(list(m.log_at(np.array([r["x"] for r in rows]))))


def test_running_counts_group_cells_not_rows(spark, cloud):
    """No row is multiplied by chains and depths on the way to the counts."""
    plan = C.ChainPlan.draw(3, 4, 5, 2)
    deltas = C.half_ranges(C.ranges(cloud, 3))
    counts = U.streaming_sketch(cloud, plan, deltas)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    expected = Counter((r["chain"], r["depth"], tuple(r["bin"])) for r in C.bin_rows(cloud, plan, deltas).collect())
    assert {(r["chain"], r["depth"], tuple(r["bin"])): r["cnt"] for r in counts.collect()} == expected


def test_one_walk_scores_and_counts(spark, cloud):
    """Visits by a limit of the score are those of rows marked before; leaves are those of the walk, NaN goes right."""
    model = I.ForestDetector(20, 64, 2).fit(cloud)
    scored = model.score(cloud)
    least = I.limit(scored, 0.1)
    marked = cloud.join(I.predict(scored, 0.1).select("row_id", "prediction"), "row_id")
    key = lambda r: (r["tree"], r["node"], r["prediction"])
    one = {key(r): (r["n"], r["inverse"]) for r in TR.node_visits(model, cloud, least).collect()}
    two = {key(r): (r["n"], r["inverse"]) for r in TR.node_visits(model, marked).collect()}
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k]) for k in one)
    assert sum(n for (tree, node, _), (n, _) in one.items() if node == 0) == 20 * cloud.count()
    x = np.random.default_rng(3).normal(size=(3, 20_000))
    x[1, ::7] = np.nan
    for t in model.shared().value[:3]:
        assert (I.ends(t, x) == list(I.walk(t, x))[-1]).all()
