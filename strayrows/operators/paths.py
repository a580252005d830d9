"""Paths of a block's rows through a chain: rows that take the same bins are met once.

A bin floor((x * 2^j + shift) / delta) never falls as x grows, so within a block it is the number of edges that x reaches; edges are
found exactly, as the least double that has the bin. The bins of a chain, a few to a byte, are a row's key; equal keys are equal paths, and
a path's cells, counters and values are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from strayrows.operators.chains import ChainPlan

#: Bins that a byte holds, bytes of a key, and the bound on the number of a bin.
DIGIT, DIGITS, LARGEST = 256, 8, 2.0**62
_SIGN = np.uint64(1 << 63)


@dataclass
class Paths:
    """Distinct paths of a block along a chain, in the order of their bins from the first depth on."""

    dims: Sequence[int]
    bins: list[np.ndarray]  # of every depth, by path
    rows: np.ndarray  # how many each stands for
    order: np.ndarray | None  # the rows, path by path

    def cells(self, mult: np.ndarray, drop: np.uint64) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Per depth: the first path of each cell, and the cell's counter in each hash row."""
        n, current = len(self.rows), {}
        sums = [np.zeros(n, np.uint64) for _ in mult]
        new = np.zeros(n, bool)
        new[:1] = True
        for d, (k, own) in enumerate(zip(self.dims, self.bins)):
            new[1:] |= own[1:] != own[:-1]
            at = np.flatnonzero(new)
            step = (own - current[k] if k in current else own).view(np.uint64)
            current[k] = own
            for j, total in enumerate(sums):
                total += step * mult[j, k]
            yield d, at, [(total[at] >> drop).view(np.int64) for total in sums]


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order."""
    bits = x.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _doubles(u: np.ndarray) -> np.ndarray:
    return np.where(u & _SIGN, u ^ _SIGN, ~u).view(np.float64)


class PathCoder:
    """Keys of paths for rows x [dim, row] between `low` and `high` in every dimension; equal bounds give equal keys."""

    def __init__(self, plan: ChainPlan, deltas: Sequence[float], low: np.ndarray, high: np.ndarray):
        self.plan, self.low, self.high = plan, low, high
        self.dim = np.array(plan.dims)
        self.used = np.unique(self.dim)
        uses = [[row[:d].count(k) for d, k in enumerate(row)] for row in plan.dims]
        factor, delta = 2.0 ** np.array(uses), np.asarray(deltas, float)[self.dim]
        step = factor, np.take_along_axis(np.array(plan.shift), self.dim, axis=1) * delta, delta
        with np.errstate(all="ignore"):
            first, last = _bin(low[self.dim], *step), _bin(high[self.dim], *step)
            usable = np.isfinite(first) & np.isfinite(last) & (delta > 0)
            usable &= (np.abs(first) < LARGEST) & (np.abs(last) < LARGEST) & (last - first < DIGIT)
        self.first = np.where(usable, first, 0).astype(np.int64)
        self.n_bins = np.where(usable, last - first, 0).astype(np.int64) + 1
        self.digits = [self._digits(row) if own.all() else None for row, own in zip(self.n_bins.tolist(), usable)]
        self._find_edges(*step)

    @classmethod
    def of(cls, x: np.ndarray, plan: ChainPlan, deltas: Sequence[float], known: PathCoder | None = None) -> PathCoder:
        """A coder that holds the rows of x, and those that the known one holds."""
        if known is not None and known.holds(x):
            return known
        low, high = np.zeros(len(x)), np.zeros(len(x))
        for k in {k for row in plan.dims for k in row}:
            low[k], high[k] = x[k].min(), x[k].max()
        if known is not None and all(np.isfinite(v).all() for v in (low, high, known.low, known.high)):
            low, high = np.minimum(low, known.low), np.maximum(high, known.high)
        return cls(plan, deltas, low, high)

    def holds(self, x: np.ndarray) -> bool:
        return all(x[k].min() >= self.low[k] and x[k].max() <= self.high[k] for k in self.used)

    @staticmethod
    def _digits(n_bins: list[int]) -> list[list[int]] | None:
        """The depths whose bins share a byte, byte by byte."""
        out: list[list[int]] = [[]]
        held = 1
        for d, b in enumerate(n_bins):
            if held * b > DIGIT:
                out.append([])
                held = 1
            out[-1].append(d)
            held *= b
        return out if len(out) <= DIGITS else None

    def _find_edges(self, *step: np.ndarray) -> None:
        """The least double of every bin but the first of a step."""
        more = (self.n_bins - 1).reshape(-1)
        of = np.repeat(np.arange(more.size), more)
        self.start = np.concatenate([[0], np.cumsum(more)]).tolist()
        wanted = self.first.reshape(-1)[of] + 1 + np.arange(len(of)) - np.array(self.start)[of]
        own, k = [v.reshape(-1)[of] for v in step], self.dim.reshape(-1)[of]
        below, at = _ordered(self.low[k]), _ordered(self.high[k])
        while len(of) and (gap := at - below).max() > 1:
            middle = below + (gap >> np.uint64(1))
            reached = _bin(_doubles(middle), *own) >= wanted
            at, below = np.where(reached, middle, at), np.where(reached, below, middle)
        self.edges = _doubles(at).tolist()

    def keys(self, c: int, x: np.ndarray) -> np.ndarray | None:
        """The key of each row's path along chain c, None if it does not fit."""
        digits, n, depth = self.digits[c], x.shape[1], self.plan.depth
        if digits is None:
            return None
        wide = next(w for w in (2, 4, 8) if w >= len(digits))
        out, digit, reached = np.zeros((n, wide), np.uint8), np.empty(n, np.uint8), np.empty(n, bool)
        for i, steps in enumerate(digits):
            digit.fill(0)
            for d in steps:
                n_bins, s = int(self.n_bins[c, d]), c * depth + d
                if n_bins == 1:
                    continue
                digit *= np.uint8(n_bins % DIGIT)  # a digit of DIGIT bins has none before it
                for edge in self.edges[self.start[s] : self.start[s + 1]]:
                    np.greater_equal(x[self.plan.dims[c][d]], edge, out=reached)
                    digit += reached.view(np.uint8)
            out[:, len(digits) - 1 - i] = digit
        return out.view(f"<u{wide}").reshape(-1)

    def paths(self, c: int, x: np.ndarray, weights: np.ndarray | None = None, ordered: bool = False) -> Paths | None:
        """Distinct paths of the rows along chain c, None if keys do not hold them."""
        keys = self.keys(c, x) if x.shape[1] else None
        return None if keys is None else self.decoded(c, *distinct(keys, weights, ordered))

    def decoded(self, c: int, keys: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None) -> Paths:
        bins: list[np.ndarray] = [None] * self.plan.depth
        digits = self.digits[c]
        for i, steps in enumerate(digits):
            rest = (keys >> keys.dtype.type(8 * (len(digits) - 1 - i)) & keys.dtype.type(255)).astype(np.int64)
            for d in reversed(steps):
                rest, own = np.divmod(rest, self.n_bins[c, d])
                bins[d] = own + self.first[c, d]
        return Paths(self.plan.dims[c], bins, rows, order)


def _bin(x: np.ndarray, factor: np.ndarray, shift: np.ndarray, delta: np.ndarray) -> np.ndarray:
    return np.floor((x * factor + shift) / delta)


def distinct(keys: np.ndarray, weights: np.ndarray | None = None, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys in order, the rows or weights of each, and the rows in their order if they are sought."""
    order = np.argsort(keys) if ordered or weights is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    rows = np.diff(np.append(starts, len(keys))) if weights is None else np.add.reduceat(weights[order], starts)
    return keys[starts], rows, order


class HeldPaths:
    """Paths of many blocks and their rows by chain."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.entries: dict[int, int] = {}

    def add(self, c: int, keys: np.ndarray, rows: np.ndarray) -> None:
        own = self.parts.setdefault(c, [])
        own.append((keys, rows))
        if len(own) > 8 or len(keys) > 1 << 16:
            self.parts[c] = [self.of(c)]
        self.entries[c] = sum(len(k) for k, _ in self.parts[c])

    def of(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = (np.concatenate(p) for p in zip(*self.parts[c]))
        return distinct(keys, rows)[:2] if len(self.parts[c]) > 1 else (keys, rows)

    def nbytes(self) -> int:
        return 16 * sum(self.entries.values())


class Filled:
    """1 + count of a chain's counters [row, place], kept for the filled ones only."""

    def __init__(self, at: np.ndarray, counts: np.ndarray, n_rows: int, width: int):
        words = -(-width // 64)
        order = np.argsort(at)
        some = np.zeros((n_rows, words * 64), bool)
        some[np.divmod(at, width)] = True
        self.words = np.packbits(some, axis=1, bitorder="little").view("<u8")
        filled = np.bitwise_count(self.words).astype(np.uint32)
        self.before = (np.cumsum(filled) - filled.reshape(-1)).astype(np.uint32).reshape(n_rows, words)
        narrow = np.uint32 if counts.max(initial=0) < np.iinfo(np.uint32).max else np.int64
        self.counts = np.append(counts[order] + 1, 1).astype(narrow)

    def at(self, row: int | np.ndarray, place: np.ndarray) -> np.ndarray:
        word = row * self.words.shape[1] + (place >> 6)
        own, low = self.words.reshape(-1)[word], np.uint64(1) << (place & 63).astype(np.uint64)
        rank = self.before.reshape(-1)[word] + np.bitwise_count(own & (low - np.uint64(1)))
        return np.where(own & low, self.counts[rank], self.counts.dtype.type(1))
