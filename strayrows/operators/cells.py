"""Keys of fixed width for the paths and cells of half-space chains.

The key of a path rolls along its bins. A cell is the latest bin of every dimension split so far; its key is a
sum over dimensions to which a split adds what its bin has changed by. Either is two independent 64-bit
numbers, so that two among n of them agree with a probability of about n * n / 2^129.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SEED = 11
#: Bin of what is no number.
MISSING = -(1 << 62)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def binned(v: np.ndarray) -> np.ndarray:
    """floor as integers, MISSING for NaN."""
    v = np.floor(v)
    gone = np.isnan(v)
    return np.where(gone, MISSING, np.where(gone, 0.0, v).astype(np.int64)) if gone.any() else v.astype(np.int64)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def path_bins(x: np.ndarray, plan, deltas: Sequence[float], c: int) -> np.ndarray:
    """[depth, row]: the bins rows pass along chain c.

    After m splits of a dimension the coordinate is floor((2^(m-1) x + s) / delta); null and NaN have bin MISSING.
    """
    out = np.empty((plan.depth, x.shape[1]), np.int64)
    uses: dict[int, int] = {}
    for d, k in enumerate(plan.dims[c]):
        uses[k] = uses.get(k, 0) + 1
        shift = plan.shift[c][k] * deltas[k]
        out[d] = binned((2.0 ** (uses[k] - 1) * x[k] + shift) / deltas[k])
    return out


def path_keys(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each path of [depth, row] bins."""
    out = []
    for factor in _FACTORS:
        h = np.zeros(bins.shape[1], np.uint64)
        for b in bins.view(np.uint64):
            h = mixed(h * factor + b + factor)
        out.append(h)
    return out[0], out[1]


def cell_keys(bins: np.ndarray, plan, c: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth from 1, both keys of each path's cell there)."""
    factors = np.random.default_rng(_SEED).integers(0, 2**63, size=(2, plan.n_dims), dtype=np.uint64) * 2 + 1
    latest: dict[int, np.ndarray] = {}
    sums = [np.zeros(bins.shape[1], np.uint64) for _ in factors]
    for d, k in enumerate(plan.dims[c]):
        new = bins[d].astype(np.int64).view(np.uint64)
        step = new - latest[k] if k in latest else new
        latest[k] = new
        for j in range(2):
            sums[j] = sums[j] + factors[j, k] * step
        yield d + 1, mixed(sums[0]), mixed(sums[1])


def distinct(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """A place of each distinct pair of keys and how often it occurs; with `n` also the sum of n."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(a) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(a)))
    if n is None:
        return order[start], times
    return order[start], times, np.add.reduceat(n[order], start) if len(a) else np.zeros(0, np.int64)
