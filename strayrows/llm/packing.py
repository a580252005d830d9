"""Packing into optimal length buckets and token-budget batches.

Documents longer than a sequence are split into whole sequences and a rest. Dynamic programming
over the global length histogram chooses the bucket boundaries with the least padding. Inside a
bucket, pieces in order of document form batches of as many rows as the token budget holds
at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.functions.prefix import running_totals
from strayrows.llm.registry import query, table
from strayrows.staging import stage


def word_count(text: Column) -> Column:
    """Words, runs without space and 0x09-0x0D, of a text; null has none."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(marked, "[\\x20\\x09-\\x0D]+", "")).cast("bigint")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most `buckets` buckets with the least total padding, and that padding.

    `lengths` ascend. Of equal solutions the one with fewer buckets, then with smaller bounds from the
    top down, wins.
    """
    n = len(lengths)
    if not n:
        return [], 0
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far, np.int64)
    best[0] = 0
    cost, choices = [best], []
    for _ in range(min(buckets, n)):
        now, came = np.full(n + 1, far, np.int64), np.zeros(n + 1, np.int64)
        for end in range(1, n + 1):
            pad = lengths[end - 1] * (rows[end] - rows[:end]) - (tokens[end] - tokens[:end])
            total = cost[-1][:end] + pad
            came[end] = total.argmin()
            now[end] = total[came[end]]
        cost.append(now)
        choices.append(came)
    k = int(np.argmin([c[n] for c in cost[1:]])) + 1
    found, end = [], n
    for came in reversed(choices[:k]):
        found.append(int(lengths[end - 1]))
        end = int(came[end])
    return found[::-1], int(cost[k][n])


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    sequence: int = 2048,
    buckets: int = 8,
    budget: int = 16384,
    n_tokens: Column | None = None,
) -> DataFrame:
    """(doc_id, piece, n_tokens, bucket, bucket_length, batch, slot): one row per piece of a document.

    Pieces number from 0; a document without tokens is one piece of length 0. Rows come in the order of
    (doc_id, piece) within a bucket, a null doc_id first; rows that repeat a doc_id and a length follow
    each other. A batch has budget // bucket_length rows (one at least), the last one of a bucket may
    have fewer. `n_tokens` counts tokens, by default words.
    """
    if sequence < 1 or buckets < 1:
        raise ValueError("sequence and buckets start at 1")
    counted = stage(
        docs.select(
            F.col(f"`{id}`").cast("bigint").alias("doc_id"),
            (word_count(F.col(f"`{text}`")) if n_tokens is None else n_tokens).alias("total"),
        ),
        "lengths",
    )
    last = F.greatest(F.ceil(F.col("total") / sequence) - 1, F.lit(0)).cast("bigint")
    pieces = counted.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id", "piece", F.least(F.col("total") - F.col("piece") * sequence, F.lit(sequence)).alias("n_tokens")
    )
    # At most sequence + 1 rows.
    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    bounds, _ = boundaries(
        np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets
    )
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds or [0]])
    fitting = F.filter(limits, lambda b: b >= F.col("n_tokens"))
    placed = pieces.select(
        "doc_id", "piece", "n_tokens",
        (F.size(limits) - F.size(fitting)).cast("bigint").alias("bucket"),
        F.element_at(fitting, 1).alias("bucket_length"),
    )
    # Equal rows are one row with a count, so that the order below is unique.
    grouped = placed.groupBy(*placed.columns).agg(F.count("*").alias("copies"))
    order = F.struct("bucket", F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "piece", "n_tokens")
    numbered = stage(running_totals(grouped, order, ["copies"]), "numbered")
    # One row per bucket, `buckets` at most.
    before = numbered.groupBy("bucket").agg((F.min("cum_copies")).alias("_low"), F.min_by("copies", "cum_copies").alias("_own"))
    ranked = numbered.join(F.broadcast(before), "bucket").select(
        *placed.columns,
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy"),
        (F.col("cum_copies") - F.col("copies") - (F.col("_low") - F.col("_own"))).alias("_before"),
    )
    rank = F.col("_before") + F.col("_copy") - 1
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1)).cast("bigint")
    return ranked.select(
        *placed.columns, F.floor(rank / rows).cast("bigint").alias("batch"), (rank % rows).alias("slot")
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
