"""Seeded token hashes that fill the random projection matrix."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strayrows.functions.blocks import list_array

DENSITY = 1.0 / 3.0

# The published constants of 32-bit Murmur3.
MURMUR_C1 = 0xCC9E2D51
MURMUR_C2 = 0x1B873593
MURMUR_ADD = 0xE6546B64
MURMUR_F1 = 0x85EBCA6B
MURMUR_F2 = 0xC2B2AE35


def _rotate(v: np.ndarray, bits: int) -> np.ndarray:
    return (v << np.uint32(bits)) | (v >> np.uint32(32 - bits))


def murmur3(tokens: Sequence[str], n_seeds: int) -> np.ndarray:
    """Murmur3-32 of every token under seeds 0..n_seeds-1, as uint32 [token, seed].

    Tokens of equal byte length are hashed together, so the work is array
    arithmetic over all of them at once.
    """
    encoded = [t.encode("utf-8") for t in tokens]
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, raw in enumerate(encoded):
        by_length[len(raw)].append(i)
    out = np.empty((len(encoded), n_seeds), dtype=np.uint32)
    seeds = np.arange(n_seeds, dtype=np.uint32)[None, :]
    with np.errstate(over="ignore"):
        for length, members in by_length.items():
            padded = length + (-length) % 4
            block = np.zeros((len(members), padded), dtype=np.uint8)
            for row, i in enumerate(members):
                block[row, :length] = np.frombuffer(encoded[i], dtype=np.uint8)
            words = block.view("<u4").astype(np.uint32)
            h = np.repeat(seeds, len(members), axis=0)
            for w in range(words.shape[1]):
                k = words[:, w : w + 1] * np.uint32(MURMUR_C1)
                h = h ^ (_rotate(k, 15) * np.uint32(MURMUR_C2))
                if (w + 1) * 4 <= length:  # a trailing partial word is mixed in without this step
                    h = _rotate(h, 13) * np.uint32(5) + np.uint32(MURMUR_ADD)
            h = h ^ np.uint32(length)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(MURMUR_F1)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(MURMUR_F2)
            out[members] = h ^ (h >> np.uint32(16))
    return out


def projection_weights(tokens: Sequence[str], n_dims: int, signed: bool = True) -> np.ndarray:
    """Weight of every token on every projection: two thirds 0, the rest +c or -c.

    With `signed=False` the non-zero weights are all 1 (plain membership).
    """
    unit = murmur3(tokens, n_dims) / (2.0**32 - 1)
    if not signed:
        return np.where(unit <= DENSITY, 1.0, 0.0)
    c = float(np.sqrt(1.0 / DENSITY) / np.sqrt(n_dims))
    return np.where(unit <= DENSITY / 2.0, -c, np.where(unit <= DENSITY, c, 0.0))


def token(feature: str, value: Column) -> Column:
    """`feature.value`, the token of a category."""
    return F.concat_ws(".", F.lit(feature), value)


def feature_weights(
    numeric: Sequence[str], numbers: Sequence[Column], categories: Sequence[str], values: Sequence[Column], n_dims: int, signed: bool = True
) -> Column:
    """Numbers times the weights of their features, plus the summed weights of category tokens, as array<double>.

    `numbers` are doubles without nulls. Only the distinct tokens of each Arrow batch are hashed, so values first
    seen while scoring need no refit and no lookup table grows with the data.
    """
    by_number = projection_weights(numeric, n_dims, signed) if numeric else np.zeros((0, n_dims))

    def weighted(columns: Sequence[pa.Array]) -> np.ndarray:
        x = [c.to_numpy(zero_copy_only=False) for c in columns]
        total = np.zeros((n_dims, len(x[0])))
        for k in range(n_dims):
            for i in np.flatnonzero(by_number[:, k]):
                total[k] += x[i] * by_number[i, k]
        return np.ascontiguousarray(total.T)

    def summed(tokens: Sequence[pa.Array]) -> np.ndarray:
        total = np.zeros((len(tokens[0]), n_dims))
        for column in tokens:
            coded = column.dictionary_encode()
            if not len(coded.dictionary):
                continue
            table = projection_weights(coded.dictionary.to_pylist(), n_dims, signed)
            codes = coded.indices.fill_null(len(table)).to_numpy(zero_copy_only=False)
            total += np.concatenate([table, np.zeros((1, n_dims))])[codes]
        return total

    @F.arrow_udf("array<double>")
    def weights(first: pa.Array, *rest: pa.Array) -> pa.Array:
        every = [first, *rest]
        own, tokens = every[: len(numeric)], every[len(numeric) :]
        if not tokens:
            return list_array(weighted(own))
        return list_array(weighted(own) + summed(tokens) if own else summed(tokens))

    return weights(*numbers, *[F.when(c.isNotNull(), token(f, c)) for f, c in zip(categories, values)])


def token_weights(column: Column, n_dims: int, signed: bool = True) -> Column:
    """Weights of one token column as array<double>."""

    @F.pandas_udf("array<double>")
    def weights(tokens: pd.Series) -> pd.Series:
        codes, values = pd.factorize(tokens)
        table = projection_weights([str(v) for v in values], n_dims, signed)
        return pd.Series([table[c] for c in codes])

    return weights(column)
