"""Half-space chains: random splits, exact bin counts, outlier scores.

A chain halves randomly chosen dimensions one depth at a time; a row that falls
into sparsely filled cells early is unusual. Here a whole ensemble is one table
job: all chains and depths are group keys, nothing loops over them. Rows that
pass a chain through the same bins share one path; depths are unfolded for
distinct paths only, so the row-level work is rows x chains.

Paths and cells are joined by two 64-bit keys of fixed width (`cells.py`), rolled along the chain; the bins
themselves stay with the distinct paths. A path is looked up LEVELS depths at a time and leaves
the frontier once one of its cells holds a single row: deeper cells can't give a smaller value.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrows.functions.blocks import list_array, matrices
from strayrows.operators import cells as K
from strayrows.spec import ID
from strayrows.staging import stage

SCORE_DIGITS = 9
HOT_PARTS = 64
BROADCAST_BYTES = 64 * 1024 * 1024
LEVELS = 8
#: Dimensions whose ranges are generated expressions; those of more make a method too long for the JVM to compile.
FEW_DIMS = 16


class DetectorModel(Protocol):
    """A fitted detector: scores any table of (row_id, x)."""

    def score(self, vectors: DataFrame) -> DataFrame: ...


class Detector(Protocol):
    """Anything with fit(vectors) -> model can take the detector's place."""

    def fit(self, vectors: DataFrame) -> DetectorModel: ...


@dataclass(frozen=True)
class ChainPlan:
    """Random choices of an ensemble, independent of the data's scale.

    `dims[c][d]` is the dimension chain c splits at depth d+1; `shift[c][k]` is
    the shift of dimension k as a share of its range. Several independent
    ensembles can be stacked in one plan: consecutive blocks of
    `chains_per_ensemble` chains belong to ensemble 0, 1, ...
    """

    dims: tuple[tuple[int, ...], ...]
    shift: tuple[tuple[float, ...], ...]
    chains_per_ensemble: int

    @classmethod
    def draw(cls, n_dims: int, n_chains: int, depth: int, seed: int) -> ChainPlan:
        rng = np.random.default_rng(seed)
        dims = rng.integers(0, n_dims, size=(n_chains, depth))
        shift = np.round(rng.random(size=(n_chains, n_dims)), 6)
        return cls(
            tuple(tuple(int(v) for v in row) for row in dims),
            tuple(tuple(float(v) for v in row) for row in shift),
            n_chains,
        )

    def block(self, first: int, last: int) -> ChainPlan:
        """Chains first..last - 1 of a single ensemble, as an ensemble of their own."""
        dims = self.dims[first:last]
        return ChainPlan(dims, self.shift[first:last], len(dims))

    @property
    def n_dims(self) -> int:
        """Dimensions up to the last one that is split."""
        return max(max(row) for row in self.dims) + 1

    @property
    def n_chains(self) -> int:
        return len(self.dims)

    @property
    def depth(self) -> int:
        return len(self.dims[0])

    @property
    def n_ensembles(self) -> int:
        return self.n_chains // self.chains_per_ensemble

    def uses(self, chain: int) -> list[dict[int, int]]:
        """Per depth, how often each dimension has been split so far."""
        seen: dict[int, int] = {}
        out = []
        for dim in self.dims[chain]:
            seen[dim] = seen.get(dim, 0) + 1
            out.append(dict(seen))
        return out

    def steps(self, deltas: Sequence[float]) -> list[dict]:
        """One record per chain: the bin term of every split along it."""
        records = []
        for c in range(self.n_chains):
            steps = []
            for d, counts in enumerate(self.uses(c)):
                k = self.dims[c][d]
                steps.append(
                    {
                        "dim": k,
                        "mult": 2.0 ** (counts[k] - 1),
                        "shift": self.shift[c][k] * deltas[k],
                        "delta": deltas[k],
                    }
                )
            records.append({"chain": c, "steps": steps})
        return records

    def keys(self) -> list[list[dict]]:
        """Per chain and depth: its split dimension and which bins of the path form the cell.

        A cell is the latest bin of every dimension split so far, in dimension order.
        """
        out = []
        for row in self.dims:
            latest: dict[int, int] = {}
            depths = []
            for d, k in enumerate(row):
                latest[k] = d
                picks = [latest[dim] for dim in sorted(latest)]
                depths.append({"depth": d + 1, "split": k, "picks": picks})
            out.append(depths)
        return out


STEPS_TYPE = (
    "array<struct<chain:int,steps:array<struct<dim:int,mult:double,shift:double,delta:double>>>>"
)
KEYS_TYPE = "array<array<struct<depth:int,split:int,picks:array<int>>>>"


def literal_table(records: list, ddl: str) -> Column:
    """Parameters as one constant array column.

    The optimizer folds it to a literal that ships with the task, so exploding
    it beside every row needs neither a join nor a broadcast exchange.
    """
    return F.from_json(F.lit(json.dumps(records)), ddl)


def ranges(vectors: DataFrame, n_dims: int, x: str = "x") -> list[tuple[float, float]]:
    """(min, max) per dimension of the vector column, in one pass; null and NaN are left out, (0, 0) without values."""
    if n_dims <= FEW_DIMS:
        entry = [F.nanvl(F.col(x)[k], F.lit(None).cast("double")) for k in range(n_dims)]
        row = vectors.agg(
            *[F.min(e).alias(f"lo{k}") for k, e in enumerate(entry)],
            *[F.max(e).alias(f"hi{k}") for k, e in enumerate(entry)],
        ).first()
        found = {k: (row[f"lo{k}"], row[f"hi{k}"]) for k in range(n_dims)}
    else:

        def extremes(batches):
            lo, hi = np.full(n_dims, np.inf), np.full(n_dims, -np.inf)
            for _, own in matrices(batches):
                lo, hi = np.fmin(lo, np.fmin.reduce(own, axis=1)), np.fmax(hi, np.fmax.reduce(own, axis=1))
            some = np.flatnonzero(lo <= hi)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(lo[some]), pa.array(hi[some])], ["k", "lo", "hi"])

        each = vectors.select(F.col(x).alias("x")).mapInArrow(extremes, "k int, lo double, hi double")
        rows = each.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # one row per dimension
        found = {r["k"]: (r["lo"], r["hi"]) for r in rows}
    return [found[k] if found.get(k, (None,))[0] is not None else (0.0, 0.0) for k in range(n_dims)]


def half_ranges(bounds: Sequence[tuple[float, float]]) -> list[float]:
    """Half the range of each dimension, 1 where it is constant."""
    return [1.0 if hi == lo else (hi - lo) / 2.0 for lo, hi in bounds]


def path_rows(vectors: DataFrame, plan: ChainPlan, deltas: Sequence[float]) -> DataFrame:
    """(row_id, chain, path): the bins a row passes along every chain.

    After m splits of a dimension its coordinate is floor((2^(m-1) x + s) / delta). Null and NaN have a bin of their own.
    """
    chains = literal_table(plan.steps(deltas), STEPS_TYPE)
    return vectors.select(ID, "x", F.explode(chains).alias("p")).select(
        ID,
        "p.chain",
        F.transform(
            "p.steps",
            lambda t: F.coalesce(
                F.when(~F.isnan(F.col("x")[t["dim"]]), F.floor((t["mult"] * F.col("x")[t["dim"]] + t["shift"]) / t["delta"])),
                F.lit(K.MISSING),
            ),
        ).alias("path"),
    )


def unfold(paths: DataFrame, plan: ChainPlan, *keep: str) -> DataFrame:
    """(<keep>, chain, depth, split, bin): the cells of (chain, path) rows at every depth."""
    keys = literal_table(plan.keys(), KEYS_TYPE)
    return paths.select(*keep, "chain", "path", F.explode(keys[F.col("chain")]).alias("p")).select(
        *keep,
        "chain",
        "p.depth",
        "p.split",
        F.transform("p.picks", lambda i: F.col("path")[i]).alias("bin"),
    )


def bin_rows(vectors: DataFrame, plan: ChainPlan, deltas: Sequence[float]) -> DataFrame:
    """(row_id, chain, depth, split, bin): the cell of every row at every depth."""
    return unfold(path_rows(vectors, plan, deltas), plan, ID)


def count_paths(vectors: DataFrame, plan: ChainPlan, deltas: Sequence[float]) -> DataFrame:
    """(chain, h1, h2, path, cnt): rows that pass a chain alike are counted in their task, then once per path."""

    def count(batches):
        for _, x in matrices(batches):
            for c in range(plan.n_chains):
                bins = K.path_bins(x, plan, deltas, c)
                h1, h2 = K.path_keys(bins)
                at, n = K.distinct(h1, h2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), c, np.int32)), K.signed(h1[at]), K.signed(h2[at]), list_array(bins[:, at].T), pa.array(n)],
                    ["chain", "h1", "h2", "path", "cnt"],
                )

    found = vectors.select("x").mapInArrow(count, PATHS)
    return found.groupBy("chain", "h1", "h2", "path").agg(F.sum("cnt").alias("cnt"))


PATHS = "chain int, h1 bigint, h2 bigint, path array<bigint>, cnt bigint"


def cells_of(paths: DataFrame, plan: ChainPlan, levels: range, count: bool) -> DataFrame:
    """(chain, h1, h2, depth, c1, c2) of counted paths at `levels`; or, to `count`, (chain, depth, c1, c2, cnt, paths)."""

    def unfold_keys(batches):
        for batch in batches:
            chain = batch.column(0).to_numpy()
            for c in np.unique(chain):
                own = batch.filter(pa.array(chain == c))
                bins = own.column(3).flatten().to_numpy().reshape(own.num_rows, -1).T
                n = own.column(4).to_numpy()
                for depth, c1, c2 in K.cell_keys(bins, plan, int(c)):
                    if depth - 1 not in levels:
                        continue
                    if count:
                        at, paths, rows = K.distinct(c1, c2, n)
                        more = {"cnt": pa.array(rows), "paths": pa.array(paths)}
                        c1, c2 = c1[at], c2[at]
                        first = {}
                    else:
                        first, more = {"h1": own.column(1), "h2": own.column(2)}, {}
                    yield pa.RecordBatch.from_pydict({
                        "chain": pa.array(np.full(len(c1), c, np.int32)), **first,
                        "depth": pa.array(np.full(len(c1), depth, np.int32)), "c1": K.signed(c1), "c2": K.signed(c2), **more,
                    })

    source = paths.select("chain", "h1", "h2", "path", "cnt")
    if count:
        found = source.mapInArrow(unfold_keys, "chain int, depth int, c1 bigint, c2 bigint, cnt bigint, paths bigint")
        return found.groupBy("chain", "depth", "c1", "c2").agg(F.sum("cnt").alias("cnt"), F.sum("paths").alias("paths"))
    return source.mapInArrow(unfold_keys, "chain int, h1 bigint, h2 bigint, depth int, c1 bigint, c2 bigint")


def sketch_of(path_counts: DataFrame, plan: ChainPlan) -> DataFrame:
    """(chain, depth, bin, cnt, paths): counts per cell from counted paths.

    Depth multiplies only the distinct paths, not the rows.
    """
    return (
        unfold(path_counts, plan, "cnt")
        .groupBy("chain", "depth", "bin")
        .agg(F.sum("cnt").alias("cnt"), F.count("*").alias("paths"))
    )


def look_up(df: DataFrame, table: DataFrame, on: list[str], small: bool, hot: DataFrame | None) -> DataFrame:
    """Left join a table with unique keys.

    A table of checked small size is broadcast. Otherwise its `hot` rows, those
    that a large share of `df` would meet and bounded in number, are broadcast
    and only the remaining rows are shuffled, so no key carries a large share.
    """
    if small:
        return df.join(F.broadcast(table), on, "left")
    hot = F.broadcast(hot)
    warm = df.join(hot, on, "inner")
    cold = df.join(hot.select(*on), on, "left_anti").join(table.hint("shuffle_merge"), on, "left")
    return warm.unionByName(cold)


def depth_value(cnt: Column, depth: Column) -> Column:
    return F.log2(F.lit(1.0) + cnt) + depth


def ensemble_scores(minima: DataFrame, plan: ChainPlan) -> DataFrame:
    """(row_id[, ensemble], score): negated mean over chains; higher is more unusual."""
    score = F.round(-F.avg("v"), SCORE_DIGITS).alias("score")
    if plan.n_ensembles == 1:
        return minima.groupBy(ID).agg(score)
    ensemble = F.floor(F.col("chain") / F.lit(plan.chains_per_ensemble)).cast("int")
    return minima.groupBy(ID, ensemble.alias("ensemble")).agg(score)


def normalise(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add score_norm in 0..1 (0 when all scores are equal), overall or per `by`."""
    if by:
        # One row per group of `by`, which are ensembles or clusters: bounded by parameters.
        limits = scores.groupBy(*by).agg(
            F.min("score").alias("_lo"), F.max("score").alias("_hi")
        )
        joined = scores.join(F.broadcast(limits), list(by))
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        joined = scores
        lo = scores.agg(F.min("score")).scalar()
        hi = scores.agg(F.max("score")).scalar()
    norm = F.when(hi == lo, F.lit(0.0)).otherwise((F.col("score") - lo) / (hi - lo))
    return joined.withColumn("score_norm", norm).drop("_lo", "_hi")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k most unusual rows; equal scores in key order."""
    return scores.orderBy(F.desc("score"), F.asc(ID)).limit(k)


CELL = ["chain", "depth", "c1", "c2"]
PATH = ["chain", "h1", "h2"]
#: What a row with the key of a cell or path and two numbers takes in memory.
ROW_BYTES = 64


@dataclass
class ChainModel:
    """Exact counts of a fitted ensemble: its distinct paths and its cells."""

    plan: ChainPlan
    deltas: list[float]
    paths: DataFrame
    cells: DataFrame
    n_cells: int
    n_paths: int
    _hot: DataFrame | None = field(default=None, repr=False)

    @property
    def sketch(self) -> DataFrame:
        """(chain, depth, bin, cnt, paths): the cells with their bins."""
        return sketch_of(self.paths, self.plan)

    def _count(self, keyed: DataFrame) -> DataFrame:
        """Add cnt to rows with the key of a cell, 0 for a cell that was never filled."""
        small = self.n_cells * ROW_BYTES <= BROADCAST_BYTES
        if not small and self._hot is None:
            # At most HOT_PARTS cells per chain and depth can exceed this share of the paths.
            share = F.col("paths") * HOT_PARTS * self.plan.n_chains
            self._hot = stage(self.cells.where(share > F.lit(self.n_paths)).drop("paths"), "hot-cells")
        found = look_up(keyed, self.cells.drop("paths"), CELL, small, self._hot)
        return found.withColumn("cnt", F.coalesce("cnt", F.lit(0)))

    def path_values(self, paths: DataFrame) -> DataFrame:
        """(chain, h1, h2, v): the smallest depth value along each of the counted `paths`.

        A path whose cell holds one row, or none, at some depth has its smallest value there or before.
        """
        out, frontier = None, paths
        for first in range(0, self.plan.depth, LEVELS):
            levels = range(first, min(first + LEVELS, self.plan.depth))
            found = self._count(cells_of(frontier, self.plan, levels, False)).groupBy(*PATH).agg(
                F.min(depth_value(F.col("cnt"), F.col("depth"))).alias("v"), F.min("cnt").alias("least")
            )
            last = levels.stop == self.plan.depth
            if not last or out is not None:
                found = stage(found, "frontier")
            out = found.select(*PATH, "v") if out is None else out.unionByName(found.select(*PATH, "v"))
            if not last:
                frontier = frontier.join(found.where("least > 1").select(*PATH), PATH, "left_semi")
        if self.plan.depth > LEVELS:
            out = out.groupBy(*PATH).agg(F.min("v").alias("v"))
        return out

    def score(self, vectors: DataFrame, fitted: bool = False) -> DataFrame:
        """(row_id[, ensemble], score). `fitted` says these are the rows of the fit, whose
        distinct paths are known already."""
        plan, deltas = self.plan, self.deltas
        paths = self.paths if fitted else stage(count_paths(vectors, plan, deltas), "paths")
        values = stage(self.path_values(paths), "path-values")
        n_values = self.n_paths if fitted else values.count()
        if n_values * ROW_BYTES <= BROADCAST_BYTES:
            return self._by_table(vectors, values)

        def keys(batches):
            for columns, x in matrices(batches):
                for c in range(plan.n_chains):
                    h1, h2 = K.path_keys(K.path_bins(x, plan, deltas, c))
                    chain = pa.array(np.full(x.shape[1], c, np.int32))
                    yield pa.RecordBatch.from_arrays([columns[0], chain, K.signed(h1), K.signed(h2)], [ID, *PATH])

        rows = vectors.select(ID, "x").mapInArrow(keys, f"{ID} bigint, chain int, h1 bigint, h2 bigint")
        size = paths.agg(F.sum("cnt")).first()[0]
        # At most HOT_PARTS paths per chain hold more than this share of the rows.
        hot = paths.where(F.col("cnt") * HOT_PARTS * plan.n_chains > F.lit(size)).select(*PATH)
        hot = stage(values.join(hot, PATH, "left_semi"), "hot-paths")
        return ensemble_scores(look_up(rows, values, PATH, False, hot), plan)

    def _by_table(self, vectors: DataFrame, values: DataFrame) -> DataFrame:
        """Scores by a broadcast of all path values, whose number the caller has checked."""
        plan, deltas = self.plan, self.deltas
        every = values.toArrow()  # BROADCAST_BYTES / ROW_BYTES rows at most
        chain, h1, h2, v = (every.column(c).to_numpy() for c in (*PATH, "v"))
        tables = []
        for c in range(plan.n_chains):
            own = np.flatnonzero(chain == c)
            a = h1[own].view(np.uint64)
            order = np.argsort(a, kind="stable")
            tables.append((a[order], h2[own].view(np.uint64)[order], v[own][order]))
        shared = vectors.sparkSession.sparkContext.broadcast(tables)
        n = plan.chains_per_ensemble

        def score(batches):
            for columns, x in matrices(batches):
                total = np.zeros((x.shape[1], plan.n_ensembles))
                for c, (a, b, least) in enumerate(shared.value):
                    own1, own2 = K.path_keys(K.path_bins(x, plan, deltas, c))
                    at = np.searchsorted(a, own1)
                    while (other := b[at] != own2).any():  # paths that share one of the keys
                        at[other] += 1
                    total[:, c // n] -= least[at]
                yield pa.RecordBatch.from_arrays([columns[0], list_array(total / n)], [ID, "s"])

        scored = vectors.select(ID, "x").mapInArrow(score, f"{ID} bigint, s array<double>")
        if plan.n_ensembles == 1:
            return scored.select(ID, F.round(F.col("s")[0], SCORE_DIGITS).alias("score"))
        each = scored.select(ID, F.posexplode("s").alias("ensemble", "score"))
        return each.withColumn("score", F.round("score", SCORE_DIGITS))

    def depth_scores(self, vectors: DataFrame) -> DataFrame:
        """(row_id, chain, depth, split, v) for every depth."""
        plan, deltas = self.plan, self.deltas

        def keys(batches):
            for columns, x in matrices(batches):
                for c in range(plan.n_chains):
                    for depth, c1, c2 in K.cell_keys(K.path_bins(x, plan, deltas, c), plan, c):
                        same = lambda v: pa.array(np.full(x.shape[1], v, np.int32))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [columns[0], same(c), same(depth), same(plan.dims[c][depth - 1]), K.signed(c1), K.signed(c2)],
                            [ID, "chain", "depth", "split", "c1", "c2"],
                        )

        schema = f"{ID} bigint, chain int, depth int, split int, c1 bigint, c2 bigint"
        keyed = vectors.select(ID, "x").mapInArrow(keys, schema)
        return self._count(keyed).select(ID, "chain", "depth", "split", depth_value(F.col("cnt"), F.col("depth")).alias("v"))

    def update(self, vectors: DataFrame) -> ChainModel:
        """The model after counting further rows; chains and ranges stay as fitted."""
        more = self.paths.unionByName(count_paths(vectors, self.plan, self.deltas))
        counted = more.groupBy(*PATH, "path").agg(F.sum("cnt").alias("cnt"))
        return _model(self.plan, self.deltas, counted)


def _model(plan: ChainPlan, deltas: list[float], paths: DataFrame) -> ChainModel:
    paths = stage(paths, "paths")
    cells = stage(cells_of(paths, plan, range(plan.depth), True), "cells")
    return ChainModel(plan, deltas, paths, cells, cells.count(), paths.count())


@dataclass(frozen=True)
class ChainDetector:
    """Exact detector. Its sketch grows with the number of distinct cells; see
    CountMinDetector for a state of fixed size."""

    n_dims: int
    n_chains: int = 50
    depth: int = 10
    seed: int = 0

    def fit(self, vectors: DataFrame) -> ChainModel:
        plan = ChainPlan.draw(self.n_dims, self.n_chains, self.depth, self.seed)
        return fit_plan(vectors, plan)


def fit_plan(
    vectors: DataFrame, plan: ChainPlan, bounds: Sequence[tuple[float, float]] | None = None
) -> ChainModel:
    if bounds is None:
        bounds = ranges(vectors, len(plan.shift[0]))
    deltas = half_ranges(bounds)
    return _model(plan, deltas, count_paths(vectors, plan, deltas))
