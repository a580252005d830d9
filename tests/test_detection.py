"""Detection: tokens, projection, chains, bounded counters."""

import math
from collections import Counter

import numpy as np
import pytest

from strayrows.functions import tokens
from strayrows.functions.blocks import runs
from strayrows.functions.tokens import projection_weights
from strayrows.operators import cells as K
from strayrows.operators import chains as C
from strayrows.operators import countmin as CM
from strayrows.operators import partitioned as T
from strayrows.operators import paths as H
from strayrows.operators.project import projection_table, vectorize
from strayrows.spec import FeatureSpec

VECTORS = "row_id bigint, x array<double>"


def random_vectors(spark, n=200, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)) * [1, 10, 100][:dims], 3)
    return x, spark.createDataFrame([(10 + 7 * i, [float(v) for v in r]) for i, r in enumerate(x)], VECTORS)


def by_hand(x, fitted, plan):
    """Scores by the incremental definition, one chain and depth at a time."""
    delta = np.ptp(fitted, axis=0) / 2
    delta[delta == 0] = 1.0
    total = np.zeros(len(x))
    for c in range(plan.n_chains):
        shift = np.array([plan.shift[c][k] for k in range(x.shape[1])]) * delta
        counts, values = [], np.zeros((len(x), plan.depth))
        pre = {n: np.zeros(a.shape) for n, a in (("fit", fitted), ("x", x))}
        used = Counter()
        for d, k in enumerate(plan.dims[c]):
            used[k] += 1
            for name, a in (("fit", fitted), ("x", x)):
                if used[k] == 1:
                    pre[name][:, k] = (a[:, k] + shift[k]) / delta[k]
                else:
                    pre[name][:, k] = 2 * pre[name][:, k] - shift[k] / delta[k]
            counts = Counter(tuple(np.floor(r).astype(int)) for r in pre["fit"])
            n = np.array([counts[tuple(np.floor(r).astype(int))] for r in pre["x"]])
            values[:, d] = np.log2(1.0 + n) + d + 1
        total -= values.min(axis=1)
    return total / plan.n_chains


def scores_of(df):
    return {r["row_id"]: r["score"] for r in df.collect()}


def test_murmur3_published_vectors():
    got = tokens.murmur3(["", "test", "Hello, world!"], 1)[:, 0]
    assert [int(v) for v in got] == [0x00000000, 0xBA6BD213, 0xC0363E43]
    assert int(tokens.murmur3([""], 2)[0, 1]) == 0x514E28B7


def test_weights_density_and_scale():
    w = tokens.projection_weights([f"t{i}" for i in range(400)], 50)
    c = math.sqrt(3) / math.sqrt(50)
    assert set(np.unique(np.round(w, 12))) == {-round(c, 12), 0.0, round(c, 12)}
    assert abs((w != 0).mean() - 1 / 3) < 0.02
    plain = tokens.projection_weights([f"t{i}" for i in range(400)], 50, signed=False)
    assert ((plain != 0) == (w != 0)).all() and set(np.unique(plain)) == {0.0, 1.0}


def test_exact_scores_match_the_incremental_definition(spark):
    x, df = random_vectors(spark)
    plan = C.ChainPlan.draw(3, 6, 7, seed=1)
    got = scores_of(C.fit_plan(df, plan).score(df))
    want = by_hand(x, x, plan)
    assert np.allclose([got[10 + 7 * i] for i in range(len(x))], want, atol=1e-8)


def test_unseen_rows_get_count_zero(spark):
    x, df = random_vectors(spark)
    plan = C.ChainPlan.draw(3, 4, 5, seed=2)
    model = C.fit_plan(df, plan)
    far = np.array([[1e6, 1e6, 1e6], x[0]])
    new = spark.createDataFrame([(1, [float(v) for v in far[0]]), (2, [float(v) for v in far[1]])], VECTORS)
    got = scores_of(model.score(new))
    want = by_hand(far, x, plan)
    assert np.allclose([got[1], got[2]], want, atol=1e-8)
    assert got[1] == pytest.approx(-1.0)


def test_fitted_shortcut_and_large_table_joins_agree(spark, monkeypatch):
    _, df = random_vectors(spark)
    hot = spark.createDataFrame([(5000 + i, [0.0, 0.0, 0.0]) for i in range(300)], VECTORS)
    df = df.unionByName(hot)
    plan = C.ChainPlan.draw(3, 4, 5, seed=3)
    model = C.fit_plan(df, plan)
    small = scores_of(model.score(df))
    assert scores_of(model.score(df, fitted=True)) == small
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    assert scores_of(model.score(df)) == small
    assert scores_of(C.fit_plan(df, plan).score(df, fitted=True)) == small


@pytest.mark.parametrize("levels", [1, 3])
def test_frontier_leaves_scores_alone(spark, monkeypatch, levels):
    x, df = random_vectors(spark)
    plan = C.ChainPlan.draw(3, 5, 20, seed=8)
    monkeypatch.setattr(C, "LEVELS", levels)
    model = C.fit_plan(df, plan)
    want = by_hand(x, x, plan)
    for got in (scores_of(model.score(df)), scores_of(model.score(df, fitted=True))):
        assert np.allclose([got[10 + 7 * i] for i in range(len(x))], want, atol=1e-8)


def test_keys_follow_bins():
    plan = C.ChainPlan.draw(4, 2, 12, seed=1)
    x = np.random.default_rng(3).normal(size=(4, 4000))
    bins = K.path_bins(x, plan, [1.0] * 4, 1)
    paths = {tuple(b) for b in bins.T}
    assert len(K.distinct(*K.path_keys(bins))[0]) == len(paths)
    picks = plan.keys()[1]
    for depth, c1, c2 in K.cell_keys(bins, plan, 1):
        at, n = K.distinct(c1, c2)
        cells = Counter(tuple(bins[picks[depth - 1]["picks"], i]) for i in range(bins.shape[1]))
        assert {tuple(bins[picks[depth - 1]["picks"], i]): m for i, m in zip(at, n)} == cells


@pytest.mark.parametrize("n_dims", [3, 201])
def test_missing_entries_have_a_bin_of_their_own(spark, n_dims):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=n_dims)]) for i in range(60)]
    for i, gone in ((0, float("nan")), (1, None), (2, float("nan"))):
        rows[i][1][0] = gone
    df = spark.createDataFrame(rows, VECTORS)
    present = [r[1][0] for r in rows[3:]]
    assert C.ranges(df, n_dims)[0] == (min(present), max(present))
    assert C.ranges(df.where("false"), n_dims) == [(0.0, 0.0)] * n_dims
    plan = C.ChainPlan(((0, 0, 1),), ((0.5,) * n_dims,), 1)
    model = C.fit_plan(df, plan)
    bins = {r["row_id"]: r["bin"] for r in C.bin_rows(df, plan, model.deltas).where("depth = 2").collect()}
    assert bins[0] == bins[1] == bins[2] == [K.MISSING] and bins[5] != bins[0]
    counted = {r["row_id"]: r["v"] for r in model.depth_scores(df).where("depth = 1").collect()}
    assert counted[0] == counted[1] == 1 + math.log2(1 + 3)
    sketched = CM.CountMinDetector(n_dims, 4, 3, 1, CM.SketchShape(3, 16)).fit(df)
    exact = C.ChainDetector(n_dims, 4, 3, 1).fit(df)
    assert scores_of(sketched.score(df)) == pytest.approx(scores_of(exact.score(df)))


def test_update_equals_one_pass(spark):
    _, df = random_vectors(spark)
    plan = C.ChainPlan.draw(3, 3, 4, seed=4)
    bounds = C.ranges(df, 3)
    whole = C.fit_plan(df, plan, bounds)
    part = C.fit_plan(df.where("row_id % 2 = 0"), plan, bounds).update(df.where("row_id % 2 = 1"))
    rows = lambda m: sorted((r["chain"], r["depth"], tuple(r["bin"]), r["cnt"]) for r in m.sketch.collect())
    assert rows(whole) == rows(part)
    assert scores_of(whole.score(df)) == scores_of(part.score(df))


def test_constant_feature_and_constant_scores(spark):
    df = spark.createDataFrame([(i, [3.0, 3.0]) for i in range(5)], VECTORS)
    assert C.half_ranges(C.ranges(df, 2)) == [1.0, 1.0]
    scores = C.normalise(C.ChainDetector(2, 3, 3).fit(df).score(df))
    assert {r["score_norm"] for r in scores.collect()} == {0.0}


def test_rows_that_differ_in_a_category_project_differently(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 2.0, "b"), (3, 2.0, "a")], "row_id bigint, v double, c string")
    spec = FeatureSpec.from_schema(df.schema)
    x = {r["row_id"]: r["x"] for r in vectorize(df, spec, 30).collect()}
    assert x[1] != x[2] and x[1] == x[3]
    table = projection_table(spark, ["v", "c.a"], 30).collect()
    weight = {(r["token"], r["k"]): r["r"] for r in table}
    assert x[1] == pytest.approx([2.0 * weight["v", k] + weight["c.a", k] for k in range(30)])


def test_category_first_seen_while_scoring(spark):
    schema = "row_id bigint, v double, c string"
    fit = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2]) for i in range(50)], schema)
    new = spark.createDataFrame([(99, 3.0, "c")], schema)
    spec = FeatureSpec.from_schema(fit.schema)
    model = C.ChainDetector(10, 10, 6).fit(vectorize(fit, spec, 10))
    usual = scores_of(model.score(vectorize(fit, spec, 10)))
    assert scores_of(model.score(vectorize(new, spec, 10)))[99] > sorted(usual.values())[25]


def test_count_min_never_below_exact_and_equal_when_wide(spark):
    _, df = random_vectors(spark)
    exact = scores_of(C.ChainDetector(3, 5, 6, 9).fit(df).score(df))
    wide = scores_of(CM.CountMinDetector(3, 5, 6, 9, CM.SketchShape(3, 16)).fit(df).score(df))
    narrow = scores_of(CM.CountMinDetector(3, 5, 6, 9, CM.SketchShape(2, 4)).fit(df).score(df))
    assert wide == pytest.approx(exact)
    assert all(narrow[k] <= exact[k] + 1e-9 for k in exact)


def test_count_min_update_and_depths(spark):
    _, df = random_vectors(spark)
    shape = CM.SketchShape(3, 16)
    whole = CM.CountMinDetector(3, 4, 5, 9, shape).fit(df)
    model = CM.CountMinModel(
        whole.plan, whole.deltas, shape,
        CM.count_cells(df.where("row_id % 2 = 0"), whole.plan, whole.deltas, shape),
    ).update(df.where("row_id % 2 = 1"))
    assert scores_of(model.score(df)) == scores_of(whole.score(df))
    exact = C.ChainDetector(3, 4, 5, 9).fit(df)
    key = lambda r: (r["row_id"], r["chain"], r["depth"], r["split"])
    a = {key(r): r["v"] for r in exact.depth_scores(df).collect()}
    b = {key(r): r["v"] for r in whole.depth_scores(df).collect()}
    assert a == pytest.approx(b)


def test_partitioned_counters_change_no_score(spark, monkeypatch):
    _, df = random_vectors(spark)
    shape = CM.SketchShape(2, 8)
    whole = CM.CountMinDetector(3, 10, 6, 3, shape).fit(df)
    cut = CM.CountMinDetector(3, 10, 6, 3, shape, block_bytes=1)
    monkeypatch.setattr(CM, "BLOCK_BYTES", 3 * 6 * 2 * 256 * 12)
    monkeypatch.setattr(T, "GROUP_ROWS", 37)
    monkeypatch.setattr(T, "FAN_IN", 2)
    parts = cut.fit(df.repartition(7))
    assert parts.packed.count() == 10 and parts._per_range == 3
    listed = lambda m: sorted((r["cell"], r["cnt"]) for r in m.cells.collect())
    assert listed(parts) == listed(whole)
    assert scores_of(parts.score(df)) == pytest.approx(scores_of(whole.score(df)))
    key = lambda r: (r["row_id"], r["chain"], r["depth"], r["split"], r["v"])
    assert sorted(map(key, parts.depth_scores(df).collect())) == sorted(map(key, whole.depth_scores(df).collect()))
    more = df.where("row_id % 2 = 0")
    assert listed(parts.update(more)) == listed(whole.update(more))


def test_neither_rows_nor_counters_are_copied_for_each_other(spark):
    """Counters leave as many tasks as there are parts, not splits of the input; rows are scored where they are."""
    _, df = random_vectors(spark)
    plan, shape = C.ChainPlan.draw(3, 10, 6, 3), CM.SketchShape(2, 8)
    size = 6 * 2 * 256

    def counting(number):
        units, table = range(number * 4, min(number * 4 + 4, 10)), np.zeros((4, size), np.int64)

        def add(x):
            for i, unit in enumerate(units):
                at, n = T.filled((i for _, _, own in CM.buckets(x, plan.block(unit, unit + 1), [1.0] * 3, shape) for i in own), 256)
                table[i][at] += n

        return units, table, add

    parts = T.gridded(df.select("x").repartition(9), 2, 3, CM._blocks, counting, size)
    assert sorted((r["unit"], r["part"]) for r in parts.select("unit", "part").collect()) == [(u, p) for u in range(10) for p in range(2)]
    counted = CM.unpacked(CM.packed_cells(df, plan, [1.0] * 3, shape))
    listed = lambda cells: sorted((r["cell"], r["cnt"]) for r in cells.collect())
    assert listed(T.opened(T.summed(parts, 2, size), size)) == listed(counted)
    model = CM.CountMinDetector(3, 10, 6, 3, shape, block_bytes=1).fit(df)
    plan_text = model.score(df)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan_text


def test_full_counters_are_packed_without_places():
    rng = np.random.default_rng(1)
    for top in (5, 300, 70_000, 1 << 40):
        for share in (0.02, 0.9):
            dense = np.where(rng.random(1000) < share, rng.integers(1, top, 1000), 0)
            at = np.flatnonzero(dense)
            row = T._packed(0, 0, at, dense[at], 1000).to_pylist()[0]
            where, n = T.places(row["at"], row["cnt"])
            assert (where == at).all() and (n == dense[at]).all()
            assert (len(row["at"]) == 1) == (share == 0.9)
    assert len(T.places(b"", b"")[0]) == 0


def test_partitioned_counters_that_are_sent_early(spark, monkeypatch):
    rows = np.arange(100.0)[None, :]

    def counting(x):
        for unit in range(4):
            yield (unit, *T.filled([x[0].astype(int) % (unit + 2)], 8))

    df = spark.createDataFrame([(i,) for i in range(6)], "i int").repartition(2)
    blocks = lambda batches: (rows for b in batches for _ in range(b.num_rows))
    expected = [(u * 8 + k, 6 * sum(j % (u + 2) == k for j in range(100))) for u in range(4) for k in range(u + 2)]
    for chunk, held in ((1, 1), (1 << 20, 1 << 20), (1, 1 << 20)):
        counted = T.partials(df, early(blocks, chunk, held), counting)
        got = T.opened(T.summed(counted, 2, 8), 8)
        assert sorted((r["cell"], r["cnt"]) for r in got.collect()) == expected


def early(blocks, chunk, held):
    """Blocks read by a worker that holds little."""

    def run(batches):
        T.CHUNK_BYTES, T.HELD_BYTES = chunk, held
        return blocks(batches)

    return run


def test_counters_of_a_chosen_width_find_planted_outliers(spark):
    """40 outliers among 20,000 rows, with about 157 rows a counter and blocks of chains."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(20_000, 4)), rng.normal(size=(40, 4)) * 0.3 + rng.choice([-7, 7], size=(40, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, x array<double>")
    shape = CM.SketchShape(2, 7)
    assert shape.foreign_rows(20_040) == 20_040 / 128
    scores = CM.CountMinDetector(4, 20, 12, 2, shape, block_bytes=128 << 10).fit(df).score(df)
    assert sum(r["row_id"] >= 20_000 for r in C.top_k(scores, 40).collect()) >= 36


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(30, 1.0), (10, 1.0), (20, 2.0), (40, 0.0)], "row_id bigint, score double")
    assert [r["row_id"] for r in C.top_k(df, 3).collect()] == [20, 10, 30]


def test_plan_is_fixed_by_the_seed():
    assert C.ChainPlan.draw(4, 3, 5, 1) == C.ChainPlan.draw(4, 3, 5, 1)
    assert C.ChainPlan.draw(4, 3, 5, 1) != C.ChainPlan.draw(4, 3, 5, 2)


def test_equal_rows_that_follow_each_other_are_met_once():
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(5, 40)), rng.integers(1, 9, 40)
    own, times = runs(np.repeat(x, n, axis=1))
    assert (own == x).all() and (times == n).all()
    assert runs(x)[1] is None and runs(np.full((2, 6), np.nan))[1] is None
    half = x.copy()
    half[0] = 1.0  # equal in the first dimension only
    assert runs(half)[1] is None


def test_rows_met_once_keep_their_counters_and_scores(spark, monkeypatch):
    vectors, _ = random_vectors(spark)
    schema, shape = "row_id bigint, x array<double>", CM.SketchShape(2, 8)
    copies = [(30 * i + j, [float(v) for v in x]) for i, x in enumerate(vectors) for j in range(30)]
    near = spark.createDataFrame(copies, schema).coalesce(1)
    far = near.repartition(5, "row_id")
    whole = CM.CountMinDetector(3, 10, 6, 3, shape).fit(far)
    model = CM.CountMinDetector(3, 10, 6, 3, shape, block_bytes=1).fit(near)
    listed = lambda m: sorted((r["cell"], r["cnt"]) for r in m.cells.collect())
    assert listed(model) == listed(whole)
    expected = scores_of(whole.score(far))
    assert scores_of(model.score(near)) == pytest.approx(expected, abs=2e-9)
    assert scores_of(model.score(far)) == pytest.approx(expected, abs=2e-9)
    monkeypatch.setattr(CM, "BLOCK_BYTES", 3 * 6 * 2 * 256 * 4)  # several ranges
    assert scores_of(model.score(near)) == pytest.approx(expected, abs=2e-9)


@pytest.mark.parametrize("kind", ["spread", "on edges", "constant", "skewed"])
def test_paths_take_the_bins_of_their_rows(kind):
    """Counters and values by path are those by row, to the bit; also for values that lie on the edges of bins."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5, 3000))
    if kind == "on edges":
        x = np.round(x * 4) / 4
    elif kind == "constant":
        x[1:3] = 4.5
    elif kind == "skewed":
        x = np.exp(5 * x)
    deltas = C.half_ranges(list(zip(x.min(axis=1), x.max(axis=1))))
    plan, shape = C.ChainPlan.draw(5, 12, 9, 4), CM.SketchShape(2, 8)
    size, coder = 9 * 2 * 256, H.PathCoder.of(x, plan, deltas)
    for c in range(12):
        by_row, by_path = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, d, index in CM.buckets(x, plan.block(c, c + 1), deltas, shape):
            for j, i in enumerate(index):
                by_row[(d * 2 + j) * 256 :][:256] += np.bincount(i, None, 256)
        paths = coder.paths(c, x, ordered=True)
        CM.count_paths(paths, by_path, shape, 5)
        assert (by_row == by_path).all()
        low = np.full(3000, np.inf)
        for _, d, index in CM.buckets(x, plan.block(c, c + 1), deltas, shape):
            least = np.min([by_row[(d * 2 + j) * 256 + i] for j, i in enumerate(index)], axis=0)
            low = np.minimum(low, (1.0 + least) * 2.0 ** (d + 1))
        at = np.flatnonzero(by_row)
        filled, found = H.Filled(at, by_row[at], 18, 256), np.empty(3000)
        found[paths.order] = np.repeat(CM.path_values(paths, filled, shape, 5), paths.rows)
        assert (found == low).all()
        assert (CM.row_values(x, plan.block(c, c + 1), deltas, shape, filled) == low).all()


def test_all_chains_are_counted_and_scored_in_one_pass(spark, monkeypatch):
    """Counters of 300 chains are 3.1 GB if all are kept, those that rows fill a part of one range."""
    x = np.random.default_rng(5).normal(size=(200, 30))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], VECTORS)
    staged, stage = [], CM.stage
    monkeypatch.setattr(CM, "stage", lambda t, tag: (staged.append(tag), stage(t, tag))[1])
    monkeypatch.setattr(CM, "chain_counters", None)
    shape = CM.SketchShape(2, 16)
    scores = scores_of(CM.CountMinDetector(30, 300, 20, 3, shape).fit(df).score(df))
    assert staged == ["chain-paths", "counters", "chain-sums"] and len(scores) == 200
    monkeypatch.undo()
    monkeypatch.setattr(CM, "path_counters", lambda *_: None)
    assert scores_of(CM.CountMinDetector(30, 300, 20, 3, shape).fit(df).score(df)) == pytest.approx(scores, abs=2e-9)


@pytest.mark.parametrize("odd", [None, float("nan"), "many paths"])
def test_rows_without_a_path_are_counted_and_scored(spark, monkeypatch, odd):
    """A value that is null or no number, or more paths than a task holds: counters and scores are those of all rows."""
    vectors, df = random_vectors(spark)
    shape = CM.SketchShape(2, 8)
    if odd == "many paths":
        monkeypatch.setattr(CM, "PATH_BYTES", -1)
    else:
        rows = [(i, [odd if i % 40 == k else float(v) for k, v in enumerate(r)]) for i, r in enumerate(vectors)]
        df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    cut = CM.CountMinDetector(3, 10, 6, 3, shape, block_bytes=1).fit(df)
    whole = CM.CountMinDetector(3, 10, 6, 3, shape).fit(df)
    listed = lambda m: sorted((r["cell"], r["cnt"]) for r in m.cells.collect())
    assert listed(cut) == listed(whole)
    assert scores_of(cut.score(df)) == pytest.approx(scores_of(whole.score(df)), abs=2e-9)
    beyond = spark.createDataFrame([(1, [1e4, -1e4, 3.0]), (2, [float(v) for v in vectors[0]])], VECTORS)  # not among those counted
    assert scores_of(cut.score(beyond)) == pytest.approx(scores_of(whole.score(beyond)), abs=2e-9)


def test_projections_are_no_generated_expressions(spark):
    """Sixty sums in one generated method are more than the JVM compiles."""
    df = spark.createDataFrame([(1, 2.0, None, "a"), (2, float("nan"), 3.0, None)], "row_id bigint, a double, b double, c string")
    spec = FeatureSpec(("a", "b", "c"), frozenset({"c"}))
    plans = [vectorize(df, spec, n)._jdf.queryExecution().optimizedPlan().toString() for n in (4, 60)]
    assert len(plans[0]) + 20 > len(plans[1])
    w = projection_weights(["a", "b", "c.a"], 60)
    x = {r["row_id"]: np.array(r["x"]) for r in vectorize(df, spec, 60).collect()}
    assert (x[1] == 2.0 * w[0] + w[2]).all()
    assert np.array_equal(x[2], np.where(w[0] != 0, np.nan, 3.0 * w[1]), equal_nan=True)


def test_ranges_of_many_dimensions_are_those_of_few(spark):
    rows = [(0, [1.0, None, float("nan")] * 10), (1, [-2.0, None, 5.0] * 10)]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>")
    assert C.ranges(df, 30) == C.ranges(df, 3) * 10 == [(-2.0, 1.0), (0.0, 0.0), (5.0, 5.0)] * 10
