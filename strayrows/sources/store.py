"""Results kept by what they were made from.

A result is found by its name and the hash of everything that decides it: parameters, and the rows of its inputs. An entry counts
once its line in the manifest is written, so a run that was cut off leaves nothing that can be read by mistake.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """Number and hash of the rows of `df` in any order, with its schema; one scan.

    The hash is a sum, so that a row counts as often as it occurs.
    """
    hashed = [F.xxhash64(F.lit(seed), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("decimal(38,0)") for seed in (1, 2)]
    n, a, b = df.agg(F.count(F.lit(1)), *[F.sum(h) for h in hashed]).first()
    return f"{df.schema.simpleString()} {n} {a} {b}"


def _plain(value):
    return asdict(value) | {"_type": type(value).__name__} if is_dataclass(value) else str(value)


@dataclass(frozen=True)
class ResultStore:
    spark: SparkSession
    path: str

    @staticmethod
    def key(parts: Mapping[str, object]) -> str:
        """The hash of parameters; DataFrames among them count by their rows."""
        named = {k: fingerprint(v) if isinstance(v, DataFrame) else v for k, v in parts.items()}
        return hashlib.sha256(json.dumps(named, sort_keys=True, default=_plain).encode()).hexdigest()

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema("name string, key string").json(f"{self.path}/manifest")

    def has(self, name: str, key: str) -> bool:
        """Whether a complete entry is there."""
        # Makes the folder where there is none; adds nothing.
        self.spark.createDataFrame([], "name string, key string").write.mode("append").json(f"{self.path}/manifest")
        return not self._manifest().where((F.col("name") == name) & (F.col("key") == key)).isEmpty()

    def get(self, name: str, parts: Mapping[str, object], build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
        """The result made from `parts`: the one that is there, or else built, saved and read.

        `reuse=False` builds it in any case. Results made from anything else stay beside it and are never taken for it.
        """
        key = self.key(parts)
        at = f"{self.path}/{name}/{key}"
        known = self.has(name, key)
        if not (known and reuse):
            build().write.mode("overwrite").parquet(at)
        if not known:
            line = self.spark.createDataFrame([(name, key)], "name string, key string")
            line.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return self.spark.read.parquet(at)
