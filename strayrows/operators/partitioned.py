"""Counters of any total size, partitioned by units of chains.

A unit is a run of chains whose counters fit in one task. A task counts its split for all units in one scan and sends
the filled counters of a unit as one packed row; rows of a unit are added up in a tree whose nodes
take at most FAN_IN of them. No counter passes through the driver and none is broadcast:
to score, rows meet the counters of a unit group by group, as many rows to a group as
one task holds, and a row's values are added up over the units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of vectors that a counting task holds, and filled counters before it sends them, in bytes.
CHUNK_BYTES = 96 << 20
HELD_BYTES = 256 << 20
FAN_IN = 16
#: Rows that meet a unit's counters at a time.
GROUP_ROWS = 1 << 17
PACKED = "unit int, part int, at binary, cnt binary"

#: (unit, place and count of its filled counters) of a block of rows.
Counting = Callable[[np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def filled(index: Iterable[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the filled counters of consecutive rows of `width` counters; one index at a time."""
    at, cnt = [], []
    for i, own in enumerate(index):
        n = np.bincount(own, minlength=width)
        some = np.flatnonzero(n)
        at.append((some + i * width).astype(np.uint32))
        cnt.append(n[some])
    return np.concatenate(at), np.concatenate(cnt)


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    cnt = np.zeros(len(at), np.int64)
    np.add.at(cnt, back, np.concatenate([a[1], b[1]]))
    return at, cnt


def _chunks(blocks: Iterator[np.ndarray], row_bytes: int | None) -> Iterator[np.ndarray]:
    """[dim, row] blocks joined until their rows take about CHUNK_BYTES."""
    held, size = [], 0
    for x in blocks:
        held.append(x)
        size += x.shape[1] * row_bytes if row_bytes else x.nbytes
        if size >= CHUNK_BYTES:
            yield np.concatenate(held, axis=1)
            held, size = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def _packed(unit: int, part: int, at: np.ndarray, cnt: np.ndarray, size: int | None = None) -> pa.RecordBatch:
    """Places and counts; of `size` counters that are mostly filled, the counts of all with their width as the place."""
    narrow = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if t == np.int64 or cnt.max(initial=0) <= np.iinfo(t).max)
    wide = np.dtype(narrow).itemsize
    if size is not None and size * wide < len(at) * (4 + wide):
        every = np.zeros(size, narrow)
        every[at] = cnt
        # Bytes of equal weight side by side: the upper ones are nearly all 0 and take no room once compressed.
        where, counts = bytes([wide]), every.view(np.uint8).reshape(size, wide).T.tobytes()
    else:
        where, counts = at.astype(np.uint32).tobytes(), cnt.astype(narrow).tobytes()
    cells = [pa.array([unit], pa.int32()), pa.array([part], pa.int32())]
    return pa.RecordBatch.from_arrays(
        [*cells, pa.array([where], pa.binary()), pa.array([counts], pa.binary())], names=["unit", "part", "at", "cnt"]
    )


_TYPES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def places(at: bytes, cnt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What a packed row holds."""
    if len(at) == 1:
        wide = at[0]
        every = np.ascontiguousarray(np.frombuffer(cnt, np.uint8).reshape(wide, -1).T).view(_TYPES[wide]).reshape(-1)
        where = np.flatnonzero(every)
        return where, every[where]
    where = np.frombuffer(at, np.uint32)
    return where, np.frombuffer(cnt, _TYPES[len(cnt) // max(len(where), 1) or 8])


def path_row(unit: int, part: int, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Keys of paths, bytes of equal weight side by side, and the rows of each."""
    narrow = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if t == np.int64 or rows.max(initial=0) <= np.iinfo(t).max)
    wide = keys.dtype.itemsize
    at = bytes([wide]) + np.ascontiguousarray(keys).view(np.uint8).reshape(-1, wide).T.tobytes()
    cells = [pa.array([v], t) for v, t in ((unit, pa.int32()), (part, pa.int32()), (at, pa.binary()), (rows.astype(narrow).tobytes(), pa.binary()))]
    return pa.RecordBatch.from_arrays(cells, names=["unit", "part", "at", "cnt"])


def path_of(at: bytes, cnt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What `path_row` holds."""
    wide = at[0]
    keys = np.ascontiguousarray(np.frombuffer(at, np.uint8, offset=1).reshape(wide, -1).T).view(f"<u{wide}").reshape(-1)
    return keys, np.frombuffer(cnt, _TYPES[len(cnt) // max(len(keys), 1) or 8]).astype(np.int64)


def partials(
    rows: DataFrame, blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], counting: Counting, row_bytes: int | None = None
) -> DataFrame:
    """Packed counters of each task of `rows`, one row per unit unless a task fills more than HELD_BYTES.

    `row_bytes` is what a row takes while it is counted, if that is more than its vector.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), {}, 0
        for x in _chunks(blocks(batches), row_bytes):
            for unit, at, cnt in counting(x):
                before = held.get(unit)
                held[unit] = (at, cnt) if before is None else _added(before, (at, cnt))
                size += 12 * (len(held[unit][0]) - (0 if before is None else len(before[0])))
            if size > HELD_BYTES:
                for unit in sorted(held):
                    yield _packed(unit, part, *held.pop(unit))
                size = 0
        for unit in sorted(held):
            yield _packed(unit, part, *held.pop(unit))

    return rows.mapInArrow(count, PACKED)


def gridded(
    rows: DataFrame, splits: int, n_ranges: int, blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], counting, size: int
) -> DataFrame:
    """Packed counters of `splits` parts of `rows`, one row per unit and part.

    A task counts one part for one of `n_ranges` ranges of units: `counting(range)` gives the units of the range, a dense
    table [unit, size] and a function that adds a block of rows to it. Parts are read once for every range and never shuffled, so what
    the tasks send is `splits` times the counters, whatever the number of rows.
    """
    ranges = rows.sparkSession.range(0, n_ranges, 1, n_ranges).select(F.col("id").cast("int").alias("range"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() // n_ranges, None

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for batch in batches:
                if batch.num_rows:
                    number = batch.column(batch.schema.get_field_index("range"))[0].as_py()
                    yield batch.drop_columns(["range"])

        units = table = add = None
        for x in blocks(own()):
            if table is None:
                units, table, add = counting(number)
            add(x)
        for i, unit in enumerate(units or ()):
            at = np.flatnonzero(table[i])
            yield _packed(unit, part, at, table[i][at], size)

    return rows.coalesce(splits).hint("shuffle_replicate_nl").crossJoin(ranges).mapInArrow(count, PACKED)


def summed(parts: DataFrame, n_parts: int, size: int) -> DataFrame:
    """One packed row per unit of `size` counters; no node of the tree adds the rows of more than FAN_IN parts."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for at, cnt in zip(group.column("at").to_pylist(), group.column("cnt").to_pylist()):
            where, n = places(at, cnt)
            total[where] += n
        at = np.flatnonzero(total)
        unit, part = group.column("unit")[0].as_py(), group.column("part")[0].as_py()
        return pa.Table.from_batches([_packed(unit, part, at, total[at], size)])

    while n_parts > FAN_IN:
        n_parts = -(-n_parts // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = parts.groupBy("unit", "part").applyInArrow(add, PACKED)
    return parts.groupBy("unit").applyInArrow(add, PACKED)


def opened(packed: DataFrame, size: int) -> DataFrame:
    """(cell, cnt) of all filled counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, at, cnt in zip(*[batch.column(c).to_pylist() for c in ("unit", "at", "cnt")]):
                where, n = places(at, cnt)
                cell = where.astype(np.int64) + unit * size
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "cnt"])

    return packed.mapInArrow(run, "cell bigint, cnt bigint")


def packed_cells_of(cells: DataFrame, size: int) -> DataFrame:
    """Packed rows of (cell, cnt), `size` counters to a unit."""

    def pack(group: pa.Table) -> pa.Table:
        at = group.column("cell").to_numpy()
        unit = int(at[0] // size)
        order = np.argsort(at)
        return pa.Table.from_batches([_packed(unit, 0, at[order] - unit * size, group.column("cnt").to_numpy()[order])])

    unit = F.floor(F.col("cell") / size).alias("unit")
    return cells.groupBy(unit).applyInArrow(pack, PACKED)


def met(rows: DataFrame, n_rows: int, packed: DataFrame, per_range: int, n_units: int, scored, schema: str) -> DataFrame:
    """`scored(range, rows, tables)` for all rows against all units, `per_range` units at a time.

    `rows` has row_id, `n_rows` different ones; with a column `unit` a row meets that unit only (per_range is 1).
    `tables` holds (at, cnt) by unit. A group has about GROUP_ROWS rows at most, by a hash of row_id, and the
    counters of its units.
    """
    splits = max(1, -(-n_rows // GROUP_ROWS))
    last = (n_units - 1) // per_range
    own = F.col("unit") if "unit" in rows.columns else F.explode(F.sequence(F.lit(0), F.lit(last)))
    left = rows.withColumn("range", own).withColumn("split", F.pmod(F.xxhash64("row_id"), F.lit(splits)).cast("int"))
    right = packed.select(
        F.floor(F.col("unit") / per_range).cast("int").alias("range"), "unit", "at", "cnt",
        F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"),
    )

    def group(key: tuple, own: pa.Table, tables: pa.Table) -> pa.Table:
        if not own.num_rows:  # counters that no row asks for
            return out_schema.empty_table()
        held = {}
        for unit, at, cnt in zip(*[tables.column(c).to_pylist() for c in ("unit", "at", "cnt")]):
            held[unit] = places(at, cnt)
        return scored(key[0].as_py(), own, held)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    return left.groupBy("range", "split").cogroup(right.groupBy("range", "split")).applyInArrow(group, schema)


def dense(table: tuple[np.ndarray, np.ndarray] | None, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    if table is not None:
        out[table[0]] = table[1]
    return out
