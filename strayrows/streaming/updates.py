"""Structured Streaming: keep counts current, score arriving rows.

Chains and ranges are frozen from a bootstrap batch; values outside the ranges
still fall into a bin. Counts commute, so late rows need no watermark. State has a fixed size where it is
made of counters (`blocks.py`, `log.py`); exact counts grow with the filled cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strayrows.functions.blocks import list_array, matrices
from strayrows.operators import cells as K
from strayrows.operators.chains import ChainPlan
from strayrows.operators.countmin import (
    BLOCK_BYTES,
    CountMinModel,
    PartitionedModel,
    SketchShape,
    chain_counters,
    count_cells,
)
from strayrows.operators.partitioned import opened, packed_cells_of
from strayrows.spec import ID
from strayrows.staging import remove, stage
from strayrows.streaming.log import CounterLog


def streaming_sketch(vectors: DataFrame, plan: ChainPlan, deltas: Sequence[float]) -> DataFrame:
    """Running exact counts (chain, depth, bin, cnt) of a streaming (row_id, x); start it in update or complete mode.

    Rows that fall into one cell are counted in their task, so it is cells and not rows x chains x depths that are
    grouped.
    """
    deltas = list(deltas)
    picks = [[depth["picks"] for depth in chain] for chain in plan.keys()]

    def count(batches):
        for _, x in matrices(batches):
            for c in range(plan.n_chains):
                bins = K.path_bins(x, plan, deltas, c)
                at, paths = K.distinct(*K.path_keys(bins))
                bins = bins[:, at]
                for depth, c1, c2 in K.cell_keys(bins, plan, c):
                    at, _, n = K.distinct(c1, c2, paths)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), c, np.int32)), pa.array(np.full(len(at), depth, np.int32)),
                         list_array(bins[picks[c][depth - 1]][:, at].T), pa.array(n)],
                        ["chain", "depth", "bin", "cnt"],
                    )

    cells = vectors.select("x").mapInArrow(count, "chain int, depth int, bin array<bigint>, cnt bigint")
    return cells.groupBy("chain", "depth", "bin").agg(F.sum("cnt").alias("cnt"))


def streaming_cells(
    vectors: DataFrame, plan: ChainPlan, deltas: Sequence[float], shape: SketchShape
) -> DataFrame:
    """Running count-min counters; the state never holds more rows than counters."""
    return count_cells(vectors, plan, deltas, shape)


def write_latest(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest complete counts as a table at `path`, over the rows now available."""

    def save(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class ScoringStep:
    """Scores a micro-batch against the counters so far, then adds its rows to them.

    Scores go to `path`/scores/epoch=<n>, counters to a log below `path`/counters. The batch is evaluated once. An epoch reads
    the counters of the one before and replaces its own folders, so a repeated batch changes nothing.
    """

    def __init__(self, spark, bootstrap: CountMinModel | PartitionedModel, path: str, count_first: bool = False, every: int = 8):
        self.plan, self.deltas, self.shape = bootstrap.plan, bootstrap.deltas, bootstrap.shape
        self.path, self.count_first = path, count_first
        size = self.plan.depth * self.shape.hashes * self.shape.width
        self.log = CounterLog(spark, f"{path}/counters", size, every)
        self.log.start(packed_cells_of(bootstrap.cells, size))

    def model(self, until: int) -> CountMinModel | PartitionedModel:
        """The detector after epoch `until`."""
        packed = self.log.summed(until)
        if self.shape.table_bytes(self.plan) > BLOCK_BYTES:
            return PartitionedModel(self.plan, self.deltas, self.shape, stage(packed, "counters"))
        return CountMinModel(self.plan, self.deltas, self.shape, opened(packed, self.log.size))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        held = f"{self.path}/batch/{epoch}"
        batch.select(ID, "x").write.mode("overwrite").parquet(held)
        rows = batch.sparkSession.read.schema(batch.select(ID, "x").schema).parquet(held)
        counted = chain_counters(rows, self.plan, self.deltas, self.shape)
        if self.count_first:
            self.log.commit(epoch, counted)
        model = self.model(epoch if self.count_first else epoch - 1)
        model.score(rows).write.mode("overwrite").parquet(f"{self.path}/scores/epoch={epoch}")
        if not self.count_first:
            self.log.commit(epoch, counted)
        remove(batch.sparkSession, held)


def score_and_count(
    vectors: DataFrame,
    bootstrap: CountMinModel | PartitionedModel,
    path: str,
    checkpoint: str,
    count_first: bool = False,
    every: int = 8,
) -> StreamingQuery:
    """Score each micro-batch against the counts so far, then add its rows to them."""
    return (
        vectors.writeStream.foreachBatch(ScoringStep(vectors.sparkSession, bootstrap, path, count_first, every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_blocks(blocks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest counters of every block at `path`: an epoch writes them all, the last two epochs stay."""

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch:
            before = spark.read.schema(batch.schema).parquet(f"{path}/epoch={epoch - 1}")
            both = before.withColumn("now", F.lit(0)).unionByName(batch.withColumn("now", F.lit(1)))
            latest = both.groupBy("block").agg(F.max(F.struct("now", "counts")).alias("last"))
            batch = latest.select("block", "last.counts")
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        remove(spark, f"{path}/epoch={epoch - 2}")

    return (
        blocks.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_blocks(spark, path: str) -> DataFrame:
    """(block, counts) after the last epoch."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("epoch")).first()[0]
    return every.where(F.col("epoch") == last).select("block", "counts")


def counters_after(spark, path: str, plan: ChainPlan, shape: SketchShape, epoch: int) -> DataFrame:
    """(cell, cnt) after an epoch of `score_and_count`, one of the last."""
    log = CounterLog(spark, f"{path}/counters", plan.depth * shape.hashes * shape.width)
    return opened(log.summed(epoch), log.size)


def read_scores(spark, path: str) -> DataFrame:
    """(row_id, score, epoch) of all batches so far."""
    return spark.read.parquet(f"{path}/scores").withColumn("epoch", F.col("epoch").cast("long"))
