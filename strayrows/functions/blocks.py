"""Vectors of Arrow batches as NumPy matrices and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_ROWS = 65_536
ROWS_HELD = 1 << 22
#: Equal rows are taken together where no more than this share of a block's rows differ from the one before.
MOSTLY = 0.75


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Join small Arrow batches; yield the other columns and x as [dim, row]."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_ROWS:
            yield joined(held)
            held, rows = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> tuple[list[pa.Array], np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    x = table.column("x").combine_chunks()
    flat = x.flatten().to_numpy(zero_copy_only=False)
    columns = [table.column(n).combine_chunks() for n in table.column_names if n != "x"]
    return columns, np.ascontiguousarray(flat.reshape(len(x), -1).T)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """[dim, row] without rows equal to the one before, and how many rows each stands for; None if most of them differ."""
    n = x.shape[1]
    most = n * MOSTLY
    new = np.zeros(n, bool)
    new[:1] = True
    for own in x:
        new[1:] |= own[1:] != own[:-1]
        if np.count_nonzero(new) > most:
            return x, None
    at = np.flatnonzero(new)
    return np.ascontiguousarray(x[:, at]), np.diff(np.append(at, n))


def distinct_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray | None]]:
    """As `matrices`, with rows that equal the one before left out of x, and how many rows each row of x stands for.

    Blocks are joined until they hold BATCH_ROWS different rows, or ROWS_HELD rows. Counts are None where every row stands for itself.
    """
    held: list[tuple] = []
    different = rows = 0

    def merged() -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        columns = [pa.concat_arrays(parts) for parts in zip(*[c for c, _, _ in held])]
        return columns, np.concatenate([x for _, x, _ in held], axis=1), np.concatenate([n for _, _, n in held])

    for columns, x in matrices(batches):
        all_rows = x.shape[1]
        x, n = runs(x)
        if n is None:
            yield columns, x, None
            continue
        held.append((columns, x, n))
        different, rows = different + x.shape[1], rows + all_rows
        if different >= BATCH_ROWS or rows >= ROWS_HELD:
            yield merged()
            held, different, rows = [], 0, 0
    if held:
        yield merged()


def list_array(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))
