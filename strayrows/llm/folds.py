"""Held-out documents, and bounded samples of labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id: str) -> Column:
    """crc32 of the identifier's text, modulo 4; null for a null identifier."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4))


def held_out(id: str) -> Column:
    return F.coalesce(fold(id) == 2, F.lit(False))


def sampled(labelled: DataFrame, id: str, most: int) -> DataFrame:
    """At most `most` rows outside the held-out fold, those with the smallest hash of `id`."""
    return labelled.where(fold(id) != 2).orderBy(F.xxhash64(id), id).limit(most)
