"""Words of texts inside a task: spans, 64-bit hashes and window hashes as NumPy arrays.

A word is a longest run of bytes other than space and 0x09-0x0D of the UTF-8 text, which is
what `bytes.split()` gives; multi-byte characters hold no such byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers.clear()
        for r in (_R, _R_INVERSE):
            factors = np.full(size, r, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of a list of texts, joined to one buffer with a line feed after each.

    `starts`, `ends`: byte spans in `data`; `first[i]:first[i + 1]` are the words of text i.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        black = np.concatenate([[False], ~WHITE[self.data], [False]])
        edges = np.flatnonzero(black[1:] != black[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.array([0, *map(len, texts)], np.int64) + np.array([0] + [1] * len(texts), np.int64)
        self.offsets = np.cumsum(sizes)
        self.first = np.searchsorted(self.starts, self.offsets)
        self._total: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of each span, wherever in the buffer it lies."""
        power, inverse = powers(len(self.data) + 1)
        if self._total is None:
            self._total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTES[self.data] * power[:-1], out=self._total[1:])
        return mixed((self._total[ends] - self._total[starts]) * inverse[starts])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_R)
        out += h[j : j + n]
    return mixed(out)


class Runs:
    """Hashes of runs of word hashes; equal runs have equal hashes wherever they stand."""

    def __init__(self, h: np.ndarray):
        self.power, self.inverse = powers(len(h) + 1)
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.power[:-1], out=self.total[1:])

    def _sum(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.inverse[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self._sum(starts, ends) + (ends - starts).astype(np.uint64))

    def without(self, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the runs without the word at place `at`, as `hashes` gives for what is left."""
        rest = self._sum(starts + at + 1, ends) * self.power[at]
        return mixed(self._sum(starts, starts + at) + rest + (ends - starts - 1).astype(np.uint64))


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: first word, word after the last, text, number of the line in it from 0."""
    breaks = np.flatnonzero(words.data == 10)
    ends = np.searchsorted(words.starts, breaks)
    starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]]) if len(ends) else ends
    doc = np.searchsorted(words.offsets, breaks, side="right") - 1
    number = np.arange(len(breaks)) - np.searchsorted(breaks, words.offsets)[doc]
    has = ends > starts
    return starts[has], ends[has], doc[has], number[has]


def window_fits(words: Words, k: int) -> np.ndarray:
    """Whether the window of k words that starts at a word lies within its text."""
    n = max(len(words) - k + 1, 0)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words))
    return left[:n] >= k


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes at most, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
