"""Columns of the input that an operator hands through, under names of their own while it works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kept_columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"_keep_{c}") for c in names]


def restored(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`_keep_{c}`").alias(c) for c in names]


def output_type(source: DataFrame, carried: Sequence[str], more: str) -> T.StructType:
    """The columns `carried` of `source`, then those of the DDL string `more`."""
    return T.StructType([source.schema[c] for c in carried] + T.StructType.fromDDL(more).fields)
