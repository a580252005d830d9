"""Half-space chains over a count-min table of fixed size.

The exact sketch grows with the data; here every chain and depth owns `hashes`
rows of `width` counters. Counting is a partial sum per input partition plus one
small aggregation, scoring reads a broadcast table of bounded size. Estimates never
fall below the exact counts; a counter holds rows / width foreign rows on average, so
the width is chosen from the error that is acceptable, never from the number of
chains. Counters beyond BLOCK_BYTES are packed by chain (`partitioned.py`) and met by the rows one range after the other. Rows that
take the same bins along a chain are counted and scored once (`paths.py`): a task keeps the distinct paths of its rows for all chains; where these
are too many, rows are counted by parts and ranges of chains. The scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.functions.blocks import BATCH_ROWS, distinct_matrices, joined, list_array, matrices
from strayrows.operators import partitioned as T
from strayrows.operators.cells import binned
from strayrows.operators.chains import SCORE_DIGITS, ChainPlan, half_ranges, literal_table, ranges
from strayrows.operators.paths import Filled, HeldPaths, PathCoder, Paths, distinct
from strayrows.spec import ID
from strayrows.staging import stage

BLOCK_BYTES = 256 * 1024 * 1024
TASKS_PER_CORE = 4
#: Distinct paths that a counting task holds.
PATH_BYTES = 192 * 1024 * 1024
#: Counters that travel as one array.
PART = 1 << 18
PACKED = "part int, at binary, cnt binary"


@dataclass(frozen=True)
class SketchShape:
    """Counters per chain and depth: `hashes` rows of 2^bits."""

    hashes: int = 2
    bits: int = 12
    seed: int = 1

    @property
    def width(self) -> int:
        return 1 << self.bits

    def multipliers(self, n_dims: int) -> np.ndarray:
        """Odd 64-bit multipliers [hash, dim] of the multiply-shift hash family."""
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 2**63, size=(self.hashes, n_dims), dtype=np.uint64) * 2 + 1

    def table_bytes(self, plan: ChainPlan) -> int:
        return plan.n_chains * plan.depth * self.hashes * self.width * 8

    def foreign_rows(self, n_rows: int) -> float:
        """Rows of other cells a counter holds on average: the bound on an estimate's error."""
        return n_rows / self.width


def buckets(
    x: np.ndarray, plan: ChainPlan, deltas: Sequence[float], shape: SketchShape
) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Per chain and depth, the counter index of each row in each hash row, valid until the next is asked for."""
    mult = shape.multipliers(x.shape[0])
    drop = np.uint64(64 - shape.bits)
    n = x.shape[1]
    split = {k for row in plan.dims for k in row}
    gone = {k for k in split if not np.isfinite(x[k]).all()}
    value, part = np.empty(n), np.empty(n, np.uint64)
    sums, index = ([np.empty(n, np.uint64) for _ in range(shape.hashes)] for _ in range(2))
    seen = [i.view(np.int64) for i in index]
    for c in range(plan.n_chains):
        uses: dict[int, int] = {}
        current: dict[int, np.ndarray] = {}
        for d, k in enumerate(plan.dims[c]):
            uses[k] = uses.get(k, 0) + 1
            shift = plan.shift[c][k] * deltas[k]
            if uses[k] == 1:
                np.add(x[k], shift, out=value)
            else:
                np.multiply(x[k], 2.0 ** (uses[k] - 1), out=value)
                value += shift
            value /= deltas[k]
            if k in gone:
                new = binned(value).view(np.uint64)
            else:
                new = np.floor(value, out=value).astype(np.int64).view(np.uint64)
            step = new - current[k] if k in current else new
            current[k] = new
            for j in range(shape.hashes):
                if d == 0:
                    np.multiply(step, mult[j, k], out=sums[j])
                else:
                    sums[j] += np.multiply(step, mult[j, k], out=part)
                np.right_shift(sums[j], drop, out=index[j])
            yield c, d, seen


@dataclass(frozen=True)
class CountMinDetector:
    n_dims: int
    n_chains: int = 50
    depth: int = 10
    seed: int = 0
    shape: SketchShape = SketchShape()
    fit_partitions: int | None = None
    block_bytes: int = BLOCK_BYTES

    def fit(self, vectors: DataFrame) -> CountMinModel | PartitionedModel:
        """Counters of one broadcast, or partitioned ones beyond `block_bytes`."""
        plan = ChainPlan.draw(self.n_dims, self.n_chains, self.depth, self.seed)
        bounds = ranges(vectors, self.n_dims)
        deltas = half_ranges(bounds)
        if self.shape.table_bytes(plan) > self.block_bytes:
            packed = path_counters(vectors, plan, bounds, self.shape, self.fit_partitions)
            if packed is None:
                packed = chain_counters(vectors, plan, deltas, self.shape, self.fit_partitions)
            return PartitionedModel(plan, deltas, self.shape, stage(packed, "counters"))
        cells = packed_cells(vectors, plan, deltas, self.shape, self.fit_partitions)
        return CountMinModel(plan, deltas, self.shape, unpacked(stage(cells, "count-min")))


def _table_counter(plan: ChainPlan, deltas: Sequence[float], shape: SketchShape):
    """Counts of all counters, flat, over the batches of a task."""
    deltas = list(deltas)

    def count(batches) -> np.ndarray:
        size = plan.n_chains * plan.depth * shape.hashes
        table = np.zeros((size, shape.width), dtype=np.int64)
        for _, x in matrices(batches):
            for c, d, index in buckets(x, plan, deltas, shape):
                base = (c * plan.depth + d) * shape.hashes
                for j, i in enumerate(index):
                    table[base + j] += np.bincount(i, minlength=shape.width)
        return table.reshape(-1)

    return count


def few_tasks(df: DataFrame) -> int:
    """Tasks that count, so that one table per task stays little."""
    return TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism


def _few_splits(vectors: DataFrame, partitions: int | None) -> DataFrame:
    return vectors.select("x").coalesce(partitions or few_tasks(vectors))


def packed_cells(
    vectors: DataFrame,
    plan: ChainPlan,
    deltas: Sequence[float],
    shape: SketchShape,
    partitions: int | None = None,
) -> DataFrame:
    """(part, at, cnt): the non-empty counters in arrays, PART counters a row.

    Each task sends at most one array per part, so the shuffle is bounded by tasks times table size and
    moves a few rows whatever the width.
    """
    counter = _table_counter(plan, deltas, shape)

    def pack(batches):
        flat = counter(batches)
        rows = []
        for part in range(0, -(-len(flat) // PART)):
            own = flat[part * PART : (part + 1) * PART]
            at = np.flatnonzero(own)
            if len(at):
                rows.append((part, at.astype(np.int32).tobytes(), own[at].tobytes()))
        yield _packed(rows)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(PART, dtype=np.int64)
        for at, cnt in zip(group.column("at").to_pylist(), group.column("cnt").to_pylist()):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(cnt, np.int64)
        at = np.flatnonzero(total)
        part = group.column("part")[0].as_py()
        return pa.Table.from_batches([_packed([(part, at.astype(np.int32).tobytes(), total[at].tobytes())])])

    partial = _few_splits(vectors, partitions).mapInArrow(pack, PACKED)
    return partial.groupBy("part").applyInArrow(add, PACKED)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    part, at, cnt = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(at, pa.binary()), pa.array(cnt, pa.binary())], ["part", "at", "cnt"]
    )


def unpacked(packed: DataFrame) -> DataFrame:
    """(cell, cnt) of packed counters."""

    def unpack(batches):
        for batch in batches:
            for part, at, cnt in zip(*(c.to_pylist() for c in batch.columns)):
                cell = np.frombuffer(at, np.int32).astype(np.int64) + part * PART
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.frombuffer(cnt, np.int64))], ["cell", "cnt"])

    return packed.mapInArrow(unpack, "cell bigint, cnt bigint")


def count_cells(
    vectors: DataFrame,
    plan: ChainPlan,
    deltas: Sequence[float],
    shape: SketchShape,
    partitions: int | None = None,
) -> DataFrame:
    """(cell, cnt) of all non-empty counters, as rows that a stream can keep up to date."""
    counter = _table_counter(plan, deltas, shape)

    def count(batches):
        flat = counter(batches)
        filled = np.flatnonzero(flat)
        for at in range(0, len(filled), BATCH_ROWS):
            part = filled[at : at + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int64)), pa.array(flat[part])], ["cell", "cnt"]
            )

    partial = _few_splits(vectors, partitions).mapInArrow(count, "cell bigint, cnt bigint")
    return partial.groupBy("cell").agg(F.sum("cnt").alias("cnt"))


@dataclass
class CountMinModel:
    plan: ChainPlan
    deltas: list[float]
    shape: SketchShape
    cells: DataFrame

    def broadcast_values(self):
        """Depth values of all counters; its size is fixed by plan and shape, not by the data."""
        spark = self.cells.sparkSession
        size = self.plan.n_chains * self.plan.depth * self.shape.hashes
        filled = self.cells.toArrow()  # at most one row per counter, limited when counting
        counts = np.zeros(size * self.shape.width, dtype=np.int64)
        counts[filled.column("cell").to_numpy()] = filled.column("cnt").to_numpy()
        depth = np.tile(
            np.repeat(np.arange(1, self.plan.depth + 1), self.shape.hashes), self.plan.n_chains
        )
        values = np.log2(1.0 + counts.reshape(size, -1)) + depth[:, None]
        return spark.sparkContext.broadcast(values)

    def depth_arrays(self, vectors: DataFrame) -> DataFrame:
        """(row_id, v array): value at every (chain, depth), chain-major."""
        shared, plan, deltas, shape = self.broadcast_values(), self.plan, self.deltas, self.shape

        def values(batches):
            table = shared.value
            for columns, x in matrices(batches):
                out = np.empty((x.shape[1], plan.n_chains * plan.depth))
                for c, d, v in _values(x, table, plan, deltas, shape):
                    out[:, c * plan.depth + d] = v
                yield pa.RecordBatch.from_arrays(
                    [columns[0], list_array(out)], [ID, "v"]
                )

        return vectors.select(ID, "x").mapInArrow(values, f"{ID} bigint, v array<double>")

    def depth_scores(self, vectors: DataFrame) -> DataFrame:
        """(row_id, chain, depth, split, v) for every depth."""
        split = literal_table(self.plan.dims, "array<array<int>>")
        depth = self.plan.depth
        return (
            self.depth_arrays(vectors)
            .select(ID, F.posexplode("v").alias("i", "v"))
            .select(
                ID,
                F.floor(F.col("i") / depth).cast("int").alias("chain"),
                (F.col("i") % depth + 1).cast("int").alias("depth"),
                "v",
            )
            .select(ID, "chain", "depth", split[F.col("chain")][F.col("depth") - 1].alias("split"), "v")
        )

    def score(self, vectors: DataFrame) -> DataFrame:
        """(row_id, score), or one score per stacked ensemble as (row_id, ensemble, score)."""
        shared, plan, deltas, shape = self.broadcast_values(), self.plan, self.deltas, self.shape

        def score(batches):
            table = shared.value
            for columns, x in matrices(batches):
                total = ensemble_totals(x, table, plan, deltas, shape)
                yield pa.RecordBatch.from_arrays([columns[0], list_array(total)], [ID, "s"])

        scored = vectors.select(ID, "x").mapInArrow(score, f"{ID} bigint, s array<double>")
        if plan.n_ensembles == 1:
            return scored.select(ID, F.round(F.col("s")[0], SCORE_DIGITS).alias("score"))
        return scored.select(ID, F.posexplode("s").alias("ensemble", "score")).withColumn(
            "score", F.round("score", SCORE_DIGITS)
        )

    def update(self, vectors: DataFrame) -> CountMinModel:
        """The model after counting further rows."""
        more = count_cells(vectors, self.plan, self.deltas, self.shape)
        return CountMinModel(
            self.plan, self.deltas, self.shape, stage(merge_cells(self.cells, more), "count-min")
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (x for _, x in matrices(batches))


def _weighted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    return ((x, n) for _, x, n in distinct_matrices(batches))


def chain_counters(
    vectors: DataFrame, plan: ChainPlan, deltas: Sequence[float], shape: SketchShape, partitions: int | None = None
) -> DataFrame:
    """The counters of every chain as one packed row.

    Tasks are a grid of parts of the rows and ranges of chains, so a few parts keep all cores busy and a chain's counters
    leave a few tasks only.
    """
    size = plan.depth * shape.hashes * shape.width
    step = chains_at_once(size)
    n_ranges = -(-plan.n_chains // step)
    splits = partitions or max(1, -(-few_tasks(vectors) // (2 * n_ranges)))

    def counting(number: int):
        first, last = number * step, min((number + 1) * step, plan.n_chains)
        own, table = plan.block(first, last), np.zeros((last - first, size), np.uint32)

        def add(block: tuple[np.ndarray, np.ndarray | None]) -> None:
            x, n = block
            found = PathCoder.of(x, own, deltas)
            for c in range(own.n_chains):
                paths = found.paths(c, x, n)
                if paths is not None:
                    count_paths(paths, table[c], shape, x.shape[0])
                    continue
                weights = None if n is None else n.astype(np.float64)
                for _, d, index in buckets(x, own.block(c, c + 1), deltas, shape):
                    for j, i in enumerate(index):
                        at = (d * shape.hashes + j) * shape.width
                        table[c, at : at + shape.width] += np.bincount(i, weights, shape.width).astype(table.dtype)

        return range(first, last), table, add

    parts = T.gridded(vectors.select("x"), splits, n_ranges, _weighted_blocks, counting, size)
    return T.summed(parts, splits, size)


def path_counters(
    vectors: DataFrame, plan: ChainPlan, bounds: Sequence[tuple[float, float]], shape: SketchShape, partitions: int | None = None
) -> DataFrame | None:
    """As `chain_counters`, from one pass for all chains, or None where a task would hold too many paths.

    A task keeps the distinct paths of its rows, PATH_BYTES at most; they are counted once more by chain. Rows outside the bounds,
    null and NaN among them, have no path here.
    """
    deltas, (low, high) = half_ranges(bounds), np.array(bounds, float).reshape(-1, 2).T
    size = plan.depth * shape.hashes * shape.width
    splits = partitions or vectors.sparkSession.sparkContext.defaultParallelism

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, coder = TaskContext.get().partitionId(), HeldPaths(), PathCoder(plan, deltas, low, high)
        for x, n in _weighted_blocks(batches):
            whole = coder.holds(x) and held.nbytes() <= PATH_BYTES
            for c in range(plan.n_chains if whole else 0):
                keys = coder.keys(c, x)
                whole = keys is not None
                if not whole:
                    break
                held.add(c, *distinct(keys, n)[:2])
            if not whole:
                yield T.path_row(-1, part, np.empty(0, np.uint64), np.empty(0, np.int64))
                return
        for c in sorted(held.parts):
            yield T.path_row(c, part, *held.of(c))

    def add(group: pa.Table) -> pa.Table:
        c, total = group.column("unit")[0].as_py(), np.zeros(size, np.int64)
        coder = PathCoder(plan.block(c, c + 1), deltas, low, high)
        keys, rows = (np.concatenate(p) for p in zip(*(T.path_of(a, n) for a, n in zip(*[group.column(i).to_pylist() for i in ("at", "cnt")]))))
        count_paths(coder.decoded(0, *distinct(keys, rows)[:2]), total, shape, len(low))
        at = np.flatnonzero(total)
        return pa.Table.from_batches([T._packed(c, 0, at, total[at], size)])

    parts = stage(vectors.select("x").coalesce(splits).mapInArrow(count, T.PACKED), "chain-paths")
    if parts.where("unit < 0").limit(1).count():
        return None
    return parts.groupBy("unit").applyInArrow(add, T.PACKED)


def count_paths(paths: Paths, table: np.ndarray, shape: SketchShape, n_dims: int) -> None:
    """Add the rows of a chain's paths to its counters; rows of one cell are added together."""
    for d, at, index in paths.cells(shape.multipliers(n_dims), np.uint64(64 - shape.bits)):
        rows = np.add.reduceat(paths.rows, at).astype(table.dtype)
        for j, i in enumerate(index):
            own = (d * shape.hashes + j) * shape.width
            np.add.at(table[own : own + shape.width], i, rows)


def path_values(paths: Paths, counts: Filled, shape: SketchShape, n_dims: int) -> np.ndarray:
    """The least (1 + count) * 2^depth of each path; the rows of counters are by depth and hash."""
    cells = list(paths.cells(shape.multipliers(n_dims), np.uint64(64 - shape.bits)))
    depth = np.repeat(np.arange(len(cells)), [len(at) for _, at, _ in cells])
    least = None  # the cells of all depths are looked up together
    for j in range(shape.hashes):
        own = counts.at(depth * shape.hashes + j, np.concatenate([index[j] for _, _, index in cells]))
        least = own if least is None else np.minimum(least, own)
    value, low, first = least * 2.0 ** (depth + 1), None, 0
    for _, at, _ in cells:
        own = np.repeat(value[first : first + len(at)], np.diff(np.append(at, len(paths.rows))))
        low, first = own if low is None else np.minimum(low, own), first + len(at)
    return low


def row_values(x: np.ndarray, chain: ChainPlan, deltas: Sequence[float], shape: SketchShape, counts: Filled) -> np.ndarray:
    """As `path_values`, of every row along one chain."""
    low = None
    for _, d, index in buckets(x, chain, deltas, shape):
        least = counts.at(d * shape.hashes, index[0])
        for j in range(1, shape.hashes):
            least = np.minimum(least, counts.at(d * shape.hashes + j, index[j]))
        value = least * 2.0 ** (d + 1)
        low = value if low is None else np.minimum(low, value)
    return low


def chains_at_once(size: int) -> int:
    """Chains of `size` counters that a task holds together."""
    return max(1, BLOCK_BYTES // (size * 4))


@dataclass
class PartitionedModel:
    """Counters by chain, as large as they need be; `packed` has one row per chain."""

    plan: ChainPlan
    deltas: list[float]
    shape: SketchShape
    packed: DataFrame

    @property
    def _chain_size(self) -> int:
        return self.plan.depth * self.shape.hashes * self.shape.width

    @property
    def _per_range(self) -> int:
        """Chains whose filled counters meet a group of rows together."""
        return max(1, BLOCK_BYTES // (self._chain_size * 12))

    @property
    def cells(self) -> DataFrame:
        """(cell, cnt) of all filled counters."""
        return T.opened(self.packed, self._chain_size)

    def _meet(self, vectors: DataFrame, emit, schema: str) -> DataFrame:
        """`emit(ids, x, values of each chain of a range)`; values are [depth, row] by chain."""
        plan, deltas, shape, size, step = self.plan, self.deltas, self.shape, self._chain_size, self._per_range

        def scored(number: int, own: pa.Table, tables: dict) -> pa.Table:
            columns, x = joined(own.select([ID, "x"]).to_batches())

            def values() -> Iterator[tuple[int, np.ndarray]]:
                for c in range(number * step, min((number + 1) * step, plan.n_chains)):
                    counts = T.dense(tables.get(c), size).reshape(-1, shape.width)
                    out = np.empty((plan.depth, x.shape[1]))
                    for _, d, index in buckets(x, plan.block(c, c + 1), deltas, shape):
                        least = counts[d * shape.hashes][index[0]]
                        for j in range(1, shape.hashes):
                            least = np.minimum(least, counts[d * shape.hashes + j][index[j]])
                        out[d] = np.log2(1.0 + least) + (d + 1)
                    yield c, out

            return emit(columns[0], values())

        rows = vectors.select(ID, "x")
        return T.met(rows, rows.count(), self.packed, step, plan.n_chains, scored, schema)

    def score(self, vectors: DataFrame) -> DataFrame:
        """(row_id, score): the mean over all chains.

        Rows stay where they are: ranges of chains reach them one after the other as a broadcast of at most BLOCK_BYTES of filled
        counters, which ends before the next, and a row leaves one sum for each range. A depth's value log2(1 + count) + depth grows with
        (1 + count) * 2^depth, so the least product of a path is found first and one logarithm taken of it.
        """
        plan, deltas, shape, size = self.plan, self.deltas, self.shape, self._chain_size
        spark, sums = vectors.sparkSession, None
        for first, last in self._ranges():
            own = plan.block(first, last)
            shared = spark.sparkContext.broadcast(self._counts(first, last))

            def add(batches, own=own, shared=shared):
                counts, found = shared.value, None
                for columns, x, n in distinct_matrices(batches):
                    total, found = np.zeros(x.shape[1]), PathCoder.of(x, own, deltas, found)
                    for c in range(own.n_chains):
                        paths = found.paths(c, x, ordered=True)
                        if paths is None:
                            total += np.log2(row_values(x, own.block(c, c + 1), deltas, shape, counts[c]))
                        else:
                            total[paths.order] += np.repeat(np.log2(path_values(paths, counts[c], shape, len(x))), paths.rows)
                    if n is not None:
                        total = np.repeat(total, n)
                    yield pa.RecordBatch.from_arrays([columns[0], pa.array(total)], [ID, "s"])

            part = stage(vectors.select(ID, "x").mapInArrow(add, f"{ID} bigint, s double"), "chain-sums")
            shared.destroy()
            sums = part if sums is None else sums.unionByName(part)
        if chains_at_once(size) >= plan.n_chains:
            return sums.select(ID, F.round(-F.col("s") / plan.n_chains, SCORE_DIGITS).alias("score"))
        return sums.groupBy(ID).agg(F.round(-F.sum("s") / plan.n_chains, SCORE_DIGITS).alias("score"))

    def _ranges(self) -> list[tuple[int, int]]:
        """Chains whose filled counters, and a place map for each chain, take BLOCK_BYTES at most together."""
        every = F.when(F.length("at") == 1, F.lit(self._chain_size)).otherwise(F.length("at") / 4)
        filled = {r["unit"]: r["n"] for r in self.packed.select("unit", every.alias("n")).collect()}  # one row per chain
        out, first, held = [], 0, 0
        for c in range(self.plan.n_chains):
            own = 4 * int(filled.get(c, 0)) + self._chain_size * 3 // 16 + 8
            if c > first and held + own > BLOCK_BYTES:
                out.append((first, c))
                first, held = c, 0
            held += own
        return [*out, (first, self.plan.n_chains)]

    def _counts(self, first: int, last: int) -> list[Filled]:
        """Filled counters of the chains first..last - 1; no more than their size, which is fixed by plan and shape."""
        held = self.packed.where((F.col("unit") >= first) & (F.col("unit") < last)).select("unit", "at", "cnt").toArrow()
        rows = self.plan.depth * self.shape.hashes
        none = np.empty(0, np.int64)
        found = {unit: T.places(at, cnt) for unit, at, cnt in zip(*[held.column(c).to_pylist() for c in ("unit", "at", "cnt")])}
        return [Filled(*(v.astype(np.int64) for v in found.get(c, (none, none))), rows, self.shape.width) for c in range(first, last)]

    def depth_scores(self, vectors: DataFrame) -> DataFrame:
        """(row_id, chain, depth, split, v) for every depth."""

        def emit(ids: pa.Array, values) -> pa.Table:
            parts = [pa.table({ID: ids, "chain": pa.array(np.full(len(ids), c, np.int32)), "v": list_array(v.T)}) for c, v in values]
            return pa.concat_tables(parts)

        split = literal_table(self.plan.dims, "array<array<int>>")
        return (
            self._meet(vectors, emit, f"{ID} bigint, chain int, v array<double>")
            .select(ID, "chain", F.posexplode("v").alias("i", "v"))
            .select(ID, "chain", (F.col("i") + 1).alias("depth"), split[F.col("chain")][F.col("i")].alias("split"), "v")
        )

    def update(self, vectors: DataFrame) -> PartitionedModel:
        """The model after counting further rows."""
        more = chain_counters(vectors, self.plan, self.deltas, self.shape)
        both = T.summed(self.packed.unionByName(more), 1, self._chain_size)
        return PartitionedModel(self.plan, self.deltas, self.shape, stage(both, "counters"))


def merge_cells(*cells: DataFrame) -> DataFrame:
    merged = cells[0]
    for c in cells[1:]:
        merged = merged.unionByName(c)
    return merged.groupBy("cell").agg(F.sum("cnt").alias("cnt"))


def _values(x, table, plan, deltas, shape):
    for c, d, index in buckets(x, plan, deltas, shape):
        base = (c * plan.depth + d) * shape.hashes
        v = table[base][index[0]]
        for j in range(1, shape.hashes):
            v = np.minimum(v, table[base + j][index[j]])
        yield c, d, v


def ensemble_totals(x, table, plan, deltas, shape) -> np.ndarray:
    """Outlier score [row, ensemble] of a block of rows."""
    total = np.zeros((x.shape[1], plan.n_ensembles))
    lowest = None
    for c, d, v in _values(x, table, plan, deltas, shape):
        lowest = v if d == 0 else np.minimum(lowest, v)
        if d == plan.depth - 1:
            total[:, c // plan.chains_per_ensemble] -= lowest
    return total / plan.chains_per_ensemble
