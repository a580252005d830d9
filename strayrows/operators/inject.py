"""Labelled outliers with known causes, for evaluating detectors and attributions.

Normal rows come from the table itself. Each numeric feature gets a mixture of
Gaussians, each category its value shares; the abnormality of a row is the
negative sum of its log densities, so the effect of one replaced value is known.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrows.functions.arrays import let, total
from strayrows.functions.draws import normal, uniform
from strayrows.functions.joins import lookup
from strayrows.operators.chains import literal_table
from strayrows.operators.prep import limits
from strayrows.spec import ID, FeatureSpec, quote
from strayrows.staging import stage

INFLATE = 5.0
NOISE = 0.01
SEGMENTS = 512
#: Cells have 1 / (CENTRE * PER_UNIT) of the quartile distance at the median, and 1 / PER_UNIT of their distance far from it.
CENTRE, PER_UNIT = 8.0, 128.0


@dataclass(frozen=True)
class Mixture:
    """Gaussian mixture of one feature and the range of its normal values."""

    weights: tuple[float, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    lo: float
    hi: float
    min_log: float = 0.0

    def log_at(self, x: np.ndarray) -> np.ndarray:
        """The log density of each of `x`, on the driver."""
        w, m, s = (np.array(v)[:, None] for v in (self.weights, self.means, self.sds))
        logs = np.log(w) - np.log(s) - 0.5 * math.log(2 * math.pi) - 0.5 * ((x - m) / s) ** 2
        peak = logs.max(axis=0)
        return peak + np.log(np.exp(logs - peak).sum(axis=0))

    def unlikely(self, lo: float, hi: float) -> list[tuple[float, float]]:
        """The intervals of [lo, hi] where the density is below every normal value's.

        The density of some Gaussians changes sides between their means a few times at most; a grid
        that is finer around each mean finds the changes, bisection places them.
        """
        near = np.linspace(-8.0, 8.0, 257)
        grid = np.concatenate([np.linspace(lo, hi, 4097), *[m + s * near for m, s in zip(self.means, self.sds)]])
        grid = np.unique(grid[(grid >= lo) & (grid <= hi)])
        below = self.log_at(grid) < self.min_log
        out, start = [], lo if below[0] else None
        for i in np.flatnonzero(below[1:] != below[:-1]):
            a, b = float(grid[i]), float(grid[i + 1])
            for _ in range(60):
                mid = 0.5 * (a + b)
                if (self.log_at(np.array([mid]))[0] < self.min_log) == below[i]:
                    a = mid
                else:
                    b = mid
            if below[i]:  # the last point known to be inside
                out.append((start, a))
                start = None
            else:
                start = b
        return out + ([(start, hi)] if start is not None else [])

    def log_density(self, x: Column) -> Column:
        parts = literal_table(
            [
                {"a": math.log(w) - math.log(s) - 0.5 * math.log(2 * math.pi), "m": m, "s": s}
                for w, m, s in zip(self.weights, self.means, self.sds)
            ],
            "array<struct<a:double,m:double,s:double>>",
        )
        # Named once: an expression within a lambda is worked out for every element of the array.
        return let(
            F.transform(parts, lambda p: p["a"] - F.pow((x - p["m"]) / p["s"], 2) * F.lit(0.5)),
            lambda logs: let(F.array_max(logs), lambda peak: peak + F.ln(total(F.transform(logs, lambda v: F.exp(v - peak))))),
        )


def fit_mixtures(
    df: DataFrame, features: Sequence[str], max_components: int = 10, max_iter: int = 100
) -> dict[str, Mixture]:
    """Of each feature the mixture of 1..max_components Gaussians with the lowest BIC.

    Two passes over the table for all features: ranges and quartiles, then counts and means of cells. A cell's edges
    follow from median and quartile distance only: even around the median, in proportion to the distance in the tails, so
    far values have cells of their own and leave those of the body as they are. Cells merge by adding, and there are
    some thousands whatever the table. The mixtures are fitted to them; nulls and what is not finite are left out.
    """
    if not features:
        return {}
    bounds = limits(df, list(features))
    unknown = [f for f in features if bounds[f][0] is None]
    if unknown:
        raise ValueError(f"no values of {unknown}")
    finite = lambda x: F.when(F.abs(x) < F.lit(math.inf), x)
    numbers = [finite(F.col(quote(f)).cast("double")) for f in features]
    row = df.agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, x in enumerate(numbers)]).first()
    shape = {}
    for i, f in enumerate(features):
        q1, q2, q3 = row[f"q{i}"]
        lo, hi = bounds[f]
        shape[f] = (q2, q3 - q1 or hi - lo or 1.0)
    cell = lambda x, at, scale: F.floor(F.asinh((x - at) / scale * CENTRE) * PER_UNIT)
    each = [F.struct(F.lit(i).alias("i"), x.alias("x"), cell(x, *map(F.lit, shape[f])).alias("cell")) for i, (f, x) in enumerate(zip(features, numbers))]
    rows = (
        df.select(F.inline(F.array(*each)))
        .where("x IS NOT NULL")
        .groupBy("i", "cell")
        .agg(F.count("*").alias("n"), F.avg("x").alias("x"))
        .collect()  # some thousands for each feature
    )
    found = {}
    for i, f in enumerate(features):
        own = sorted((r["x"], r["n"]) for r in rows if r["i"] == i)
        x, n = np.array([r[0] for r in own]), np.array([float(r[1]) for r in own])
        found[f] = _lowest_bic(x, n, *bounds[f], *shape[f], max_components, max_iter)
    least = df.agg(
        *[F.min(found[f].log_density(F.col(quote(f)).cast("double"))).alias(f"m{i}") for i, f in enumerate(features)]
    ).first()
    return {f: replace(found[f], min_log=float(least[f"m{i}"])) for i, f in enumerate(features)}


def fit_mixture(df: DataFrame, feature: str, max_components: int = 10, max_iter: int = 100) -> Mixture:
    return fit_mixtures(df, [feature], max_components, max_iter)[feature]


def _lowest_bic(
    x: np.ndarray, n: np.ndarray, lo: float, hi: float, middle: float, scale: float, max_components: int, max_iter: int
) -> Mixture:
    if hi == lo:
        return Mixture((1.0,), (lo,), (1e-3,), lo, hi)
    best, lowest = None, math.inf
    for k in range(1, min(max_components, len(x)) + 1):
        w, m, s, log_likelihood = _gaussians((x - middle) / scale, n, k, max_iter)
        bic = -2.0 * log_likelihood + (3 * k - 1) * math.log(n.sum())
        if bic < lowest:
            lowest = bic
            keep = w > 1e-12
            best = Mixture(
                tuple(map(float, w[keep])), tuple(float(middle + v * scale) for v in m[keep]),
                tuple(float(v * scale) for v in s[keep]), lo, hi,
            )
    return best


def _gaussians(x: np.ndarray, n: np.ndarray, k: int, max_iter: int, tolerance: float = 1e-6):
    """Weights, means, deviations and log likelihood of k Gaussians on weighted points around 0.

    Starts from the medians and quartile distances of k groups of equal weight in ascending order, so no draw is
    needed and far values move no start.
    """
    share = (np.cumsum(n) - 0.5 * n) / n.sum()
    at = lambda q: x[np.searchsorted(share, q).clip(max=len(x) - 1)]
    group = np.arange(k) / k
    m, s = at(group + 0.5 / k), at(group + 0.75 / k) - at(group + 0.25 / k)
    s = np.maximum(s, 0.1 * max(s.max(), 1e-3))
    logs = -0.5 * ((x - m[:, None]) / s[:, None]) ** 2 - np.log(s)[:, None]
    r = np.exp(logs - logs.max(axis=0))
    r /= r.sum(axis=0)
    floor, before = (1.0 / (CENTRE * PER_UNIT)) ** 2 / 12.0, -math.inf  # of a cell at the median
    for _ in range(max_iter + 1):
        mass = (r * n).sum(axis=1) + 1e-300
        w, m = mass / n.sum(), (r * n * x).sum(axis=1) / mass
        s = np.sqrt(np.maximum((r * n * (x - m[:, None]) ** 2).sum(axis=1) / mass, floor))
        logs = np.log(w + 1e-300)[:, None] - np.log(s)[:, None] - 0.5 * math.log(2 * math.pi) - 0.5 * ((x - m[:, None]) / s[:, None]) ** 2
        peak = logs.max(axis=0)
        each = peak + np.log(np.exp(logs - peak).sum(axis=0))
        r = np.exp(logs - each)
        total_ = float((n * each).sum())
        if total_ - before < tolerance * abs(total_):
            break
        before = total_
    return w, m, s, total_


def category_shares(df: DataFrame, feature: str) -> DataFrame:
    """(value, share) of a category."""
    counts = df.groupBy(F.col(quote(feature)).cast("string").alias("value")).agg(
        F.count("*").alias("n")
    )
    return counts.select("value", (F.col("n") / df.agg(F.count("*")).scalar()).alias("share"))


def rare_category(shares: DataFrame) -> DataFrame:
    """One row: the least frequent value, first in order on ties."""
    return shares.agg(
        F.min_by("value", F.struct("share", "value")).alias("value"), F.min("share").alias("share")
    )


def local_value(mixture: Mixture, key: Column, seed: int, feature: str, positive: bool = False) -> Column:
    """A draw from the inflated mixture, given that it is less likely than every normal value."""
    sds = [s * math.sqrt(INFLATE) for s in mixture.sds]
    lo = min(m - 12.0 * s for m, s in zip(mixture.means, sds))
    hi = max(m + 12.0 * s for m, s in zip(mixture.means, sds))

    def mass(a: np.ndarray) -> np.ndarray:
        """Share of the inflated mixture below each of `a`."""
        below = lambda v, m, s: 0.5 * math.erfc((m - v) / (s * math.sqrt(2.0)))
        return np.array([sum(w * below(v, m, s) for w, m, s in zip(mixture.weights, mixture.means, sds)) for v in a])

    return _drawn(mixture.unlikely(max(lo, 0.0) if positive else lo, hi), mass, uniform(key, seed, feature, "local"), feature)


def global_value(mixture: Mixture, key: Column, seed: int, feature: str, positive: bool = False) -> Column:
    """An unlikely draw, uniform from half a range below to one and a half above the range."""
    span = mixture.hi - mixture.lo
    lo, hi = mixture.lo - 0.5 * span, mixture.hi + 1.5 * span
    return _drawn(
        mixture.unlikely(max(lo, 0.0) if positive else lo, hi), lambda a: a, uniform(key, seed, feature, "global"), feature
    )


def _drawn(intervals: list[tuple[float, float]], mass, u: Column, feature: str) -> Column:
    """The value at share `u` of the mass that lies in the intervals, linear within SEGMENTS pieces."""
    edges = []
    for a, b in intervals:
        points = np.linspace(a, b, max(2, SEGMENTS // len(intervals)) + 1)
        below = mass(points)
        edges += [(x, y, q - p) for x, y, p, q in zip(points, points[1:], below, below[1:]) if q > p]
    whole = sum(e[2] for e in edges)
    if whole <= 0.0:
        raise ValueError(f"{feature} has no value less likely than its normal ones")
    lo, hi, share = (np.array(c) for c in zip(*edges))
    upto = np.cumsum(share) / whole
    start = np.concatenate([np.zeros(1), upto[:-1]])

    @F.pandas_udf("double")
    def value(u: pd.Series) -> pd.Series:
        i = np.minimum(np.searchsorted(upto, u, side="right"), len(upto) - 1)
        return pd.Series(lo[i] + (hi[i] - lo[i]) * (u - start[i]) / (upto[i] - start[i]))

    return value(u)


@dataclass(frozen=True)
class OutlierGroup:
    """Features to inflate together; kind is `global` or `local` for numeric ones."""

    features: tuple[str, ...]
    kind: str = "global"


@dataclass(frozen=True)
class Profile:
    """What is normal: mixtures, category shares and the rarest value of each category."""

    mixtures: dict[str, Mixture]
    shares: dict[str, DataFrame]
    rare: dict[str, tuple[str, float]]


def profile(
    df: DataFrame, spec: FeatureSpec, max_components: int = 10, max_iter: int = 100
) -> Profile:
    mixtures = fit_mixtures(df, spec.numeric, max_components, max_iter)
    shares = {f: stage(category_shares(df, f), "shares") for f in spec.categories}
    rare = {}
    for f, s in shares.items():
        row = rare_category(s).first()
        rare[f] = (row["value"], row["share"])
    return Profile(mixtures, shares, rare)


def with_densities(df: DataFrame, spec: FeatureSpec, normal_profile: Profile) -> DataFrame:
    """Add `_ld_<i>`, the log density of every feature value, and the row's abnormality."""
    for i, f in enumerate(spec.features):
        if f in spec.categorical:
            named = normal_profile.shares[f].select(
                F.col("value").alias(f), F.ln("share").alias(f"_ld_{i}")
            )
            df = lookup(df, named, [f])
        else:
            x = F.col(quote(f)).cast("double")
            df = df.withColumn(f"_ld_{i}", normal_profile.mixtures[f].log_density(x))
    logs = F.array(*[F.col(f"_ld_{i}") for i in range(len(spec.features))])
    return df.withColumn("abnormality", -total(logs))


def typical_rows(scored: DataFrame, n: int) -> DataFrame:
    """The n least abnormal rows."""
    return scored.orderBy("abnormality", ID).limit(n)


def inject(
    df: DataFrame,
    spec: FeatureSpec,
    groups: Sequence[OutlierGroup],
    n_normal: int = 1000,
    n_outliers: int = 4,
    copies: int = 5,
    epsilon: float = 0.5,
    max_components: int = 10,
    max_iter: int = 100,
    positive: bool = True,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(table, truth): typical rows and outliers with a label, and why each outlier is one.

    A group's features are replaced on a typical row; the outlier is accepted if
    every replacement makes the row less likely and the row ends up clearly above
    the most abnormal typical row. Accepted outliers are copied with small noise. Too few
    acceptable rows raise a ValueError.
    """
    normal_profile = profile(df, spec, max_components, max_iter)
    scored = with_densities(df.select(ID, *[quote(f) for f in spec.features]), spec, normal_profile)
    base = stage(typical_rows(scored, n_normal), "typical")
    threshold = base.agg(F.max("abnormality")).first()[0]
    last_id = df.agg(F.max(ID)).first()[0]
    index = {f: i for i, f in enumerate(spec.features)}

    rows, truth = None, None
    for g, group in enumerate(groups):
        changed = base
        gains = []
        for f in group.features:
            i = index[f]
            if f in spec.categorical:
                value, share = normal_profile.rare[f]
                new, density = F.lit(value), F.lit(math.log(share))
            else:
                mixture = normal_profile.mixtures[f]
                make = local_value if group.kind == "local" else global_value
                changed = changed.withColumn(f"_new_{i}", make(mixture, F.col(ID), seed + g, f, positive))
                new = F.col(f"_new_{i}")
                density = mixture.log_density(new)
                if positive:
                    density = F.when(new > 0, density)
            gain = F.greatest(F.lit(0.0), F.coalesce(F.col(f"_ld_{i}") - density, F.lit(0.0)))
            changed = changed.withColumn(f"_gain_{i}", gain)
            gains.append(f"_gain_{i}")
            changed = changed.withColumn(f"_value_{i}", new)
        every = F.least(*[F.col(c) for c in gains]) if len(gains) > 1 else F.col(gains[0])
        total_gain = sum((F.col(c) for c in gains), F.lit(0.0))
        accepted = (
            changed.where(every > 0)
            .where(F.col("abnormality") + total_gain > threshold + epsilon * abs(threshold))
            .orderBy(F.xxhash64(F.col(ID), F.lit(seed + g)), ID)
            .limit(n_outliers)
        )
        accepted = stage(accepted, "accepted")
        found = accepted.count()
        if found < n_outliers:
            raise ValueError(f"only {found} of {n_outliers} outliers of {group.features} are acceptable")
        order = Window.orderBy(F.xxhash64(F.col(ID), F.lit(seed + g)), ID)  # n_outliers rows
        numbered = accepted.withColumn("_n", F.row_number().over(order) - 1).withColumn(
            "_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        )
        key = F.lit(last_id + 1 + g * n_outliers * copies) + F.col("_n") * copies + F.col("_c")
        features = []
        for f, i in index.items():
            value = F.col(f"_value_{i}") if f in group.features else F.col(quote(f))
            if f not in spec.categorical:
                m = normal_profile.mixtures[f]
                noise = normal(F.col(ID), F.col("_c"), seed + g, f, "copy")
                value = value.cast("double") + noise * F.lit(NOISE * (m.hi - m.lo))
            features.append(value.alias(f))
        made = stage(
            numbered.select(
                key.cast("bigint").alias(ID),
                *features,
                F.lit(1).alias("label"),
                *[
                    (F.col(f"_gain_{i}") if f in group.features else F.lit(0.0)).alias(f"_gain_{i}")
                    for f, i in index.items()
                ],
            ),
            "injected",
        )
        part = made.select(ID, *[quote(f) for f in spec.features], "label")
        why = made.select(ID, *[F.col(f"_gain_{i}").alias(f) for f, i in index.items()]).unpivot(
            [ID], [quote(f) for f in spec.features], "feature", "importance"
        )
        rows = part if rows is None else rows.unionByName(part)
        truth = why if truth is None else truth.unionByName(why)
    normals = base.select(
        ID,
        *[
            F.col(quote(f)).cast("string" if f in spec.categorical else "double").alias(f)
            for f in spec.features
        ],
        F.lit(0).alias("label"),
    )
    return normals.unionByName(rows), truth
