"""Which 64-bit keys occur in more than one unit of a corpus, as a bitmap of fixed size.

Tasks pack their distinct keys into arrays by key range, so the shuffle moves eight bytes per
key and few rows, and a frequent key leaves a task once. Each range is counted in
one task, whose size the number of ranges bounds, and fills its own part of the bitmap. The bitmap has false
positives, more of them the fuller it is, and no false negatives: it saves work and decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.llm.words import mixed, slices, texts_of

#: Hashes of a list of texts, and for each the number of the unit it belongs to, ascending.
Keys = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
FLUSH = 1 << 20
_SALT = np.uint64(0x51ED270B7A3C9D15)


def in_several(keys: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and whether each occurs in two units at least."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    keys, units = keys[order], units[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    end = np.append(start[1:], len(keys)) - 1
    return keys[start], units[start] != units[end]


class Filter:
    """Bitmap over key ranges; two bits per key, both in the key's range."""

    def __init__(self, bitmap: np.ndarray, ranges: int):
        self.bitmap, self.shift = bitmap, np.uint64(64 - (ranges.bit_length() - 1))
        self.region = np.uint64(len(bitmap) * 8 // ranges)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range, and two bits within it."""
        h = mixed(keys ^ _SALT)
        own = h >> self.shift if self.shift < 64 else np.zeros(len(h), np.uint64)
        return own, h & (self.region - np.uint64(1)), mixed(h) & (self.region - np.uint64(1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        own, a, b = self.places(keys)
        out = np.ones(len(keys), bool)
        for at in (a, b):
            at = own * self.region + at
            out &= (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def repeated_keys(source: DataFrame, keys: Keys, bits: int = 26):
    """A broadcast Filter of the keys that occur in two units of `source` (one text column).

    The filter has 2**bits bits whatever the number of rows. The number of ranges follows
    spark.sql.shuffle.partitions, and so does what a task holds.
    """
    spark = source.sparkSession
    ranges = 1 << max(6, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    ranges = min(ranges, 1 << (bits - 6))
    empty = Filter(np.zeros((1 << bits) // 8, np.uint8), ranges)
    shift, region = empty.shift, empty.region

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        every, several = (np.concatenate(x) for x in zip(*held))
        every, at, n = np.unique(every, return_inverse=True, return_counts=True)
        flag = n > 1
        flag[at[several]] = True
        own = (mixed(every ^ _SALT) >> shift).astype(np.int64)
        order = np.argsort(own, kind="stable")
        every, flag, own = every[order], flag[order], own[order]
        present, start = np.unique(own, return_index=True)
        parts = list(zip(start, np.append(start[1:], len(own))))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(present.astype(np.int32)),
                pa.array([every[a:b][~flag[a:b]].tobytes() for a, b in parts], pa.binary()),
                pa.array([every[a:b][flag[a:b]].tobytes() for a, b in parts], pa.binary()),
            ],
            names=["range", "once", "several"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                held.append(in_several(*keys(texts[a:b])))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def count(group: pa.Table) -> pa.Table:
        once, several = (
            np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64) for c in ("once", "several")
        )
        once = np.sort(once)
        found = np.concatenate([several, once[1:][once[1:] == once[:-1]]])
        part = np.zeros(int(region) // 8, np.uint8)
        for at in empty_places(found):
            np.bitwise_or.at(part, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return pa.table({"range": group.column("range")[:1], "part": pa.array([part.tobytes()], pa.binary())})

    def empty_places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(found ^ _SALT)
        return h & (region - np.uint64(1)), mixed(h) & (region - np.uint64(1))

    packed = source.mapInArrow(pack, "range int, once binary, several binary")
    # One part of fixed size per range: 2**bits bits in all.
    parts = packed.groupBy("range").applyInArrow(count, "range int, part binary").collect()
    for r in parts:
        size = int(region) // 8
        empty.bitmap[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["part"], np.uint8)
    return spark.sparkContext.broadcast((empty.bitmap, ranges))
