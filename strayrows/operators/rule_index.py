"""Scores of many rules in one scan.

The ends of all intervals on a feature cut its values into segments: the ends themselves and what lies between two
neighbours. A segment has a bitset of the rules that it does not rule out, a category has one too. A row then
costs one binary search a feature and the AND of a few bitsets, whatever the number of rules; no condition is tested
on a row. Rules are indexed BLOCK at a time, so a bitset stays short and the index grows in proportion to the rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.operators.rules import GROUP, Condition, merge
from strayrows.spec import quote
from strayrows.staging import stage

BLOCK = 1024
ROWS = 8192


@dataclass
class Block:
    """Rules `first`, `first` + 1, ...: `open` has the bits of those with a condition at all."""

    first: int
    size: int
    open: np.ndarray
    numeric: dict[str, tuple[np.ndarray, np.ndarray]]
    category: dict[str, tuple[dict[str, int], np.ndarray]]

    @classmethod
    def of(cls, first: int, rules: Sequence[Sequence[Condition]]) -> Block:
        words = -(-len(rules) // 64)
        every = np.zeros(words * 64, bool)
        every[: len(rules)] = [bool(r) for r in rules]
        held: dict[str, list[tuple[int, Condition]]] = {}
        for i, r in enumerate(rules):
            for c in merge(r):
                held.setdefault(c.feature, []).append((i, c))
        numeric, category = {}, {}
        for f, own in held.items():
            kept = every.copy()
            kept[[i for i, _ in own]] = False
            if own[0][1].value is None:
                ends = np.unique([x for _, c in own for x in (c.lo, c.hi)])
                # Segment 2 i is below end i, 2 i + 1 is the end; the last one is for values that are no number.
                bits = np.repeat(kept[None, :], 2 * len(ends) + 2, axis=0)
                for i, c in own:
                    bits[2 * np.searchsorted(ends, c.lo) + 1 : 2 * np.searchsorted(ends, c.hi) + 2, i] = True
                numeric[f] = ends, _packed(bits)
            else:
                values = sorted({c.value for _, c in own})
                bits = np.repeat(kept[None, :], len(values) + 1, axis=0)
                for i, c in own:
                    bits[values.index(c.value), i] = True
                category[f] = {v: i for i, v in enumerate(values)}, _packed(bits)
        return cls(first, len(rules), _packed(every[None, :])[0], numeric, category)

    def hits(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """[row, rule]: whether a row meets a rule."""
        n = len(next(iter(columns.values())))
        out = np.repeat(self.open[None, :], n, axis=0)
        for f, (ends, bits) in self.numeric.items():
            v = columns[f]
            at = np.searchsorted(ends, v)
            segment = 2 * at + (ends[np.minimum(at, len(ends) - 1)] == v)
            out &= bits[np.where(np.isnan(v), 2 * len(ends) + 1, segment)]
        for f, (values, bits) in self.category.items():
            out &= bits[[values.get(v, len(values)) for v in columns[f].tolist()]]
        return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")[:, : self.size].astype(bool)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def score_rules(rules: DataFrame, members: DataFrame, normals: DataFrame) -> DataFrame:
    """(k, cluster_id, rule_id, hits, size, outside, coverage, purity) of (k, cluster_id, rule_id, rule).

    hits and size count the members of the rule's cluster, outside the normal rows that meet it. A rule without
    conditions matches nothing; purity is null where nothing is met, coverage where the cluster is empty. The rules reach the driver and,
    indexed, every task; `members` and `normals` are read once each.
    """
    order = rules.select(*GROUP, "rule_id", "rule").orderBy(*GROUP, "rule_id").collect()
    conditions = [[Condition(c["feature"], c["lo"], c["hi"], c["value"]) for c in r["rule"]] for r in order]
    kinds = {c.feature: c.value is None for r in conditions for c in r}
    columns = [F.col(quote(f)).cast("double" if number else "string").alias(f) for f, number in sorted(kinds.items())]
    groups = [(r["k"], r["cluster_id"]) for r in order]
    blocks = [Block.of(i, conditions[i : i + BLOCK]) for i in range(0, len(order), BLOCK)]
    shared = rules.sparkSession.sparkContext.broadcast((blocks, np.array(groups).reshape(-1, 2)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, group = shared.value
        total = np.zeros(len(group), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = {n: part.column(n).to_numpy(zero_copy_only=False) for n in part.schema.names}
                for b in blocks:
                    hit = b.hits(own)
                    if "k" in own:
                        mine = group[b.first : b.first + b.size]
                        hit &= (own["k"][:, None] == mine[:, 0]) & (own["cluster_id"][:, None] == mine[:, 1])
                    total[b.first : b.first + b.size] += hit.sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.mapInArrow(counts, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias(name))

    spark = rules.sparkSession
    if not columns:
        columns = [F.lit(0.0).alias("none")]
    numbered = spark.createDataFrame(
        [(i, *g, r["rule_id"]) for i, (g, r) in enumerate(zip(groups, order))], f"i bigint, k int, cluster_id int, rule_id {rules.schema['rule_id'].dataType.simpleString()}"
    )
    inside = counted(members.select(F.col("k"), F.col("cluster_id"), *columns), "hits")
    outside = counted(normals.select(*columns), "outside")
    sizes = members.groupBy(*GROUP).agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = stage(
        numbered.join(inside, "i", "left").join(outside, "i", "left").join(F.broadcast(sizes), GROUP, "left")
        .select(*GROUP, "rule_id", zero("hits"), zero("size"), zero("outside")),
        "scored-rules",
    )
    return found.select(
        "*", F.try_divide("hits", "size").alias("coverage"), F.try_divide("hits", F.col("hits") + F.col("outside")).alias("purity")
    )
