"""Counters of a stream as a log of versions.

An epoch adds one folder of packed counters, its own rows only. Every `every` epochs they are added up to a new
base; a base counts once its entry in the manifest is written. Two bases stay and the epochs since the
older one, so what an epoch reads before it commits is there again if it is repeated, and the log has a
fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.operators import partitioned as T
from strayrows.staging import remove


@dataclass
class CounterLog:
    """Packed counters below `path`, `size` of them to a unit."""

    spark: SparkSession
    path: str
    size: int
    every: int = 8

    def start(self, packed: DataFrame) -> None:
        """The counters before epoch 0."""
        self._write_base(-1, packed)

    def versions(self) -> list[int]:
        """Epochs that a base ends with, ascending; a few."""
        entries = self.spark.read.schema("complete boolean, last bigint").parquet(f"{self.path}/manifest")
        return sorted({r["last"] for r in entries.where("complete").collect()})

    def read(self, until: int) -> DataFrame:
        """(unit, part, at, cnt): the counters after epoch `until`; several rows a unit."""
        base = max(v for v in self.versions() if v <= until)
        out = self.spark.read.schema(T.PACKED).parquet(f"{self.path}/bases/{base}")
        for epoch in range(base + 1, until + 1):
            out = out.unionByName(self.spark.read.schema(T.PACKED).parquet(self._epoch(epoch)))
        return out

    def summed(self, until: int) -> DataFrame:
        """(unit, part, at, cnt) after epoch `until`, one row a unit."""
        return T.summed(self.read(until), 1, self.size)

    def commit(self, epoch: int, packed: DataFrame) -> None:
        """Add what `epoch` has counted. To commit an epoch again replaces what it has written."""
        packed.write.mode("overwrite").parquet(self._epoch(epoch))
        if (epoch + 1) % self.every == 0:
            self._write_base(epoch, self.summed(epoch))
            self._forget()

    def _epoch(self, epoch: int) -> str:
        return f"{self.path}/epochs/{epoch}"

    def _write_base(self, last: int, packed: DataFrame) -> None:
        packed.write.mode("overwrite").parquet(f"{self.path}/bases/{last}")
        entry = self.spark.range(1).select(F.lit(True).alias("complete"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/last={last}")

    def _forget(self) -> None:
        *older, previous, _ = [None, *self.versions()]
        if previous is None:
            return
        for epoch in range(max(previous - 2 * self.every, 0), previous + 1):
            remove(self.spark, self._epoch(epoch))
        for version in older:
            if version is not None:
                remove(self.spark, f"{self.path}/manifest/last={version}")
                remove(self.spark, f"{self.path}/bases/{version}")
