"""Running counters of a stream as a fixed number of state values.

Counters are cut into blocks of BLOCK. A micro-batch is counted in its tasks; one packed row per task and block
reaches the block's state, an array that a custom stateful operator keeps in a RocksDB store. The state
has as many rows as the counters have blocks, however many rows or different cells arrive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strayrows.functions.blocks import matrices
from strayrows.operators import partitioned as T
from strayrows.operators.chains import ChainPlan
from strayrows.operators.countmin import SketchShape, buckets

BLOCK = 1 << 14
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "block int, counts binary"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which custom operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class BlockCounts(StatefulProcessor):
    """Adds packed counts to the array of a block and emits the array."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "counts binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.counts.get()
        total = np.zeros(BLOCK, np.int64) if known is None else np.frombuffer(known[0], np.int64).copy()
        for frame in rows:
            for at, cnt in zip(frame["at"], frame["cnt"]):
                where, n = T.places(at, cnt)
                total[where] += n
        counts = total.tobytes()
        self.counts.update((counts,))
        yield pd.DataFrame({"block": [key[0]], "counts": [counts]})

    def close(self) -> None:
        pass


def running_blocks(vectors: DataFrame, plan: ChainPlan, deltas: Sequence[float], shape: SketchShape) -> DataFrame:
    """(block, counts): after each micro-batch the counters of every block that it has changed, for update mode.

    Counter i of chain c at depth d in hash row j stands at ((c * depth + d) * hashes + j) * width + i, BLOCK to a block.
    """
    width, rows = shape.width, plan.depth * shape.hashes

    def counting(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for c in range(plan.n_chains):
            index = (i for _, _, own in buckets(x, plan.block(c, c + 1), deltas, shape) for i in own)
            at, cnt = T.filled(index, width)
            cell = at.astype(np.int64) + c * rows * width
            block = cell // BLOCK
            for b in np.unique(block):
                own = block == b
                yield int(b), (cell[own] - b * BLOCK).astype(np.uint32), cnt[own]

    blocks = lambda batches: (x for _, x in matrices(batches))
    packed = T.partials(vectors.select("x"), blocks, counting).withColumnRenamed("unit", "block")
    return packed.groupBy("block").transformWithStateInPandas(BlockCounts(), COUNTS, "update", "none")


def opened_blocks(blocks: DataFrame) -> DataFrame:
    """(cell, cnt) of all filled counters of (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(counts, np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at + block * BLOCK), pa.array(n[at])], names=["cell", "cnt"])

    return blocks.select("block", "counts").mapInArrow(run, "cell bigint, cnt bigint")
