"""Whitening against sums of Python integers and a symmetric eigenvalue solver."""

import math
import random

import numpy as np
import pytest

from strayrows.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, component int, deviation string, _s int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, "d", 2) for i, v in rows], SCHEMA).repartition(parts)


def integers(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def plain(rows):
    """n, integers per row, deviations, eigenvalues and vectors by falling eigenvalue, trace."""
    kept = [(i, integers(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(x) for x in zip(*[x for _, x in kept])]
    d = [[n * a - s for a, s in zip(x, sums)] for _, x in kept]
    exact = [[sum(r[i] * r[j] for r in d) for j in range(len(sums))] for i in range(len(sums))]
    v = np.array([[b / n**3 for b in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)
    z = (np.array(d, float) / n) @ vectors[:, order]
    return n, kept, [sum(a * a for a in r) for r in d], values[order], z, float(np.trace(v))


def check(spark, rows, components=8):
    n, kept, deviations, values, z, trace = plain(rows)
    source = frame(spark, rows)
    model = W.fit(source, components=components)
    found = W.transform(source, model).collect()
    rank = min(components, int((values > values[0] * 1e-12).sum()))
    assert model.n == n and len(found) == n * rank
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    ids = sorted(i for i, _ in kept)
    for c, own in by.items():
        assert sorted(r.vec_id for r in own) == ids
        expected = {i: (dev, w) for (i, _), dev, w in zip(kept, deviations, z[:, c - 1] / math.sqrt(values[c - 1]))}
        sign = 1 if sum(r.whitened * expected[r.vec_id][1] for r in own) > 0 else -1
        for r in own:
            assert r.deviation == expected[r.vec_id][0]
            assert r.whitened * sign == pytest.approx(expected[r.vec_id][1], abs=1e-8)
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
    assert W.identity_error(source, model) < 1e-9
    return model


def vectors(seed, n, size):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(size, size)) * np.linspace(0.1, 1, size)
    return [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(n, size)) @ mix + 3)]


def test_vectors(spark):
    rows = vectors(1, 300, 12)
    odd = [(900, None), (901, [None, *[1.0] * 11]), (902, [math.nan, *[1.0] * 11]), (903, [math.inf, *[1.0] * 11])]
    check(spark, rows + odd + [(5000 + i, rows[0][1]) for i in range(150)])


def test_few_dimensions_and_low_rank(spark):
    check(spark, vectors(2, 40, 3))
    flat = [(i, [v[0], v[1], v[0] * 0 + 2.0, *v[1:2]]) for i, v in vectors(3, 50, 2)]
    model = check(spark, flat)
    assert model.components.shape == (4, 2)


def test_large_entries_stay_exact(spark):
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.uniform(-1, 1) * 5e4)) for _ in range(4)]) for i in range(12)]
    check(spark, rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, [])]):
        source = frame(spark, rows)
        assert W.transform(source, W.fit(source)).collect() == []


def test_other_lengths_and_null_ids(spark):
    rows = vectors(5, 30, 4)
    mixed = frame(spark, [*rows, (None, rows[0][1]), (77, [1.0, 2.0]), (78, [])])
    found = W.transform(mixed, W.fit(mixed))
    assert found.count() == 31 * 4 and found.where("vec_id IS NULL").count() == 4
    large = frame(spark, [*rows, (88, [1e30] * 4)])
    assert W.fit(large).n == 30


def test_deviation_beyond_a_long_is_null(spark):
    source = frame(spark, [(1, [1e11, 0.0]), (2, [-1e11, 5.0]), (3, [0.0, 1.0])])
    assert [r.deviation for r in W.transform(source, W.fit(source)).where("component = 1 AND vec_id < 3").collect()] == [None, None]


def test_factor_and_rotation():
    r = np.random.default_rng(6)
    x = r.normal(size=(9, 5)).astype(np.longdouble)
    c = x @ x.T
    factor = W.pivoted_cholesky(c)
    assert factor.shape == (9, 5) and np.allclose((factor @ factor.T).astype(float), c.astype(float))
    turned = W.one_sided_jacobi(factor)
    inner = (turned.T @ turned).astype(float)
    assert np.abs(inner - np.diag(np.diag(inner))).max() < 1e-14
    assert np.allclose(np.sort(np.diag(inner)), np.linalg.eigvalsh(c.astype(float))[-5:])


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows)
