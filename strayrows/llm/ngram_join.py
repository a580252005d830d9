"""N-gram Jaccard self-join by a size-aware heavy-light method, and its components.

A document is its set of distinct word n-grams, as 64-bit hashes. Equal sets are one node.

1. A set with a partner shares nearly all its n-grams. Filters of fixed size over repeated n-grams (a
   quarter of them over the corpus, all of them over what remains) drop sets with too many n-grams of
   their own, without error, before any pair is looked for.
2. N-grams are ordered by an estimate of their frequency, rare ones first. Small sets enumerate the
   2-subsets of their prefix as keys, large sets enter inverted lists of single prefix n-grams. The boundary
   between them is the size with the least cost, counted from the sets themselves.
3. In each list the oldest set is compared with the others (a star, not all pairs), links are merged to
   components, and again with the oldest set outside. What stays open, pairs of different
   components in a list, is then compared in full, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.components import components
from strayrows.llm.registry import query, table
from strayrows.llm.repeated import Filter, repeated_keys
from strayrows.llm.words import Words, mixed, slices, texts_of, window_fits, windows
from strayrows.staging import stage

LAST = (1 << 63) - 1
#: N-grams below this hash are counted over the whole corpus: a quarter of them.
LOW = np.uint64(1 << 62)


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least part / whole, in whole numbers."""

    part: int
    whole: int

    def alien(self, n):
        """N-grams of a set of n that a partner may lack."""
        return n - -(-n * self.part // self.whole)

    def linked(self, both, union):
        return self.whole * both >= self.part * union

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.whole >= F.greatest(a, b) * self.part

    def reachable(self, most: Column, a: Column, b: Column) -> Column:
        """Whether `most` shared n-grams are enough for sets of a and b."""
        return most * (self.whole + self.part) >= self.part * (a + b)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text in ascending order, and where each text's begin.

    Fewer words than `k` are one n-gram; no word, no n-gram.
    """
    words = Words(texts, lower=True)
    h, sizes = words.hashes(), np.diff(words.first)
    fits = window_fits(words, k)
    keys, docs = windows(h, k)[fits], words.doc_of()[: len(fits)][fits]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    whole = [windows(h[words.first[i] : words.first[i + 1]], int(sizes[i])) + np.uint64(sizes[i]) for i in short]
    keys = np.concatenate([keys, *whole])
    docs = np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    return keys, np.searchsorted(docs, np.arange(len(texts) + 1))


def _low_keys(k: int):
    def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found, first = shingles(texts, k)
        low = found < LOW
        return found[low], np.repeat(np.arange(len(texts)), np.diff(first))[low]

    return keys


def _set_keys(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.frombuffer(s, np.uint64) for s in sets]
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.repeat(np.arange(len(sets)), [len(f) for f in found])


def _sets(flt, k: int, similarity: Similarity):
    """(doc, text_hash, n, node, grams): grams only where the corpus may hold a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*flt.value)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                found, first = shingles(texts[a:b], k)
                n = np.diff(first)
                doc = np.repeat(np.arange(b - a), n)
                own = (found < LOW) & ~known.has(found)
                alone = np.bincount(doc[own], minlength=b - a)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(found), dtype=np.uint64)])
                node = mixed(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
                stay = (n > 0) & (alone <= similarity.alien(n))
                grams = [found[first[i] : first[i + 1]].tobytes() if s else None for i, s in enumerate(stay)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[a:b], batch.column(2)[a:b], pa.array(n), pa.array(node.view(np.int64), mask=n == 0), pa.array(grams, pa.binary())],
                    names=["doc", "text_hash", "n", "node", "grams"],
                )

    return run


def _still(flt, similarity: Similarity):
    """Rows (node, doc, n, grams) whose n-grams a partner among them may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*flt.value)
        for batch in batches:
            sets, n = texts_of(batch.column(3)), batch.column(2).to_numpy()
            for a, b in slices(sets):
                grams, unit = _set_keys(sets[a:b])
                alone = np.bincount(unit[~known.has(grams)], minlength=b - a)
                yield batch[a:b].filter(pa.array(alone <= similarity.alien(n[a:b])))

    return run


def frequencies(sets: DataFrame, bits: int, parts: int = 64):
    """A broadcast array of 2**bits counters of n-gram hashes over all sets; sums are exact, cells shared."""
    size = (1 << bits) // parts

    def count(batches):
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sets = texts_of(batch.column(0))
            for a, b in slices(sets):
                keys, _ = _set_keys(sets[a:b])
                np.add.at(cells, (keys >> np.uint64(64 - bits)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()),
             pa.array([cells[i * size : (i + 1) * size].tobytes() for i in range(parts)], pa.binary())],
            names=["part", "cells"],
        )

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32) for c in group.column("cells").to_pylist())
        return pa.table({"part": group.column("part")[:1], "cells": pa.array([total.tobytes()], pa.binary())})

    cells = np.zeros(1 << bits, np.uint32)
    spec = "part int, cells binary"
    for r in sets.select("grams").mapInArrow(count, spec).groupBy("part").applyInArrow(add, spec).collect():
        cells[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["cells"], np.uint32)
    return sets.sparkSession.sparkContext.broadcast(cells)


def _prefix(grams: np.ndarray, cells: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `length` n-grams, rare ones first, and their estimated frequencies."""
    bits = len(cells).bit_length() - 1
    often = cells[(grams >> np.uint64(64 - bits)).astype(np.int64)]
    order = np.lexsort((grams, often))[:length]
    return grams[order], often[order]


#: An entry of an inverted list is compared with its list's oldest set, as often as not in vain; that costs about as
#: much as writing and grouping this many keys.
SCAN = 4


def _costs(cells_, similarity: Similarity):
    """(class, subsets, scanned) per size class: the keys that small-set treatment writes, and the cost of the
    list entries of the other. Entries count once, since a list is compared with one set at a time, not pair by pair.
    """

    def run(batches):
        cells = cells_.value
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, grams in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                p = similarity.alien(n)
                _, often = _prefix(np.frombuffer(grams, np.uint64), cells, p + 2)
                shared, listed = int((often > 1).sum()), int((often[: p + 1] > 1).sum())
                cost = np.array([shared * (shared - 1) // 2, SCAN * listed])
                size = int(np.log(n) / np.log(similarity.whole / similarity.part))
                out[size] = out.get(size, 0) + cost
        yield pa.RecordBatch.from_pylist(
            [{"size": k, "subsets": int(v[0]), "scanned": int(v[1])} for k, v in out.items()],
            schema=pa.schema([("size", pa.int32()), ("subsets", pa.int64()), ("scanned", pa.int64())]),
        )

    return run


def boundary(costs: dict[int, tuple[int, int]], similarity: Similarity) -> int:
    """The largest size treated as small; 0 if lists are cheapest for all.

    Sets up to 1 / similarity times the boundary must enumerate too, to meet small partners.
    """
    ratio, top = similarity.whole / similarity.part, max(costs, default=-1)
    total = lambda b: sum(
        (s if c <= b + 1 else 0) + (l if c > b else 0) for c, (s, l) in costs.items()
    ) if b >= 0 else sum(l for _, l in costs.values())
    best = min(range(-1, top + 1), key=total)
    return 0 if best < 0 else int(ratio ** (best + 1))


def _postings(cells_, similarity: Similarity, small: int):
    """(key, doc, node, n, at): keys of each set; `at` is the place of the key's first n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = cells_.value
        for batch in batches:
            for node, doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), texts_of(batch.column(3))):
                p, keys, at = similarity.alien(n), [], []
                grams, often = _prefix(np.frombuffer(raw, np.uint64), cells, p + 2)
                if n > small:
                    single = np.flatnonzero(often[: p + 1] > 1)  # an n-gram counted once is in no other set
                    keys.append(mixed(grams[single]))
                    at.append(single)
                if n * similarity.part <= small * similarity.whole and n > 1:
                    i, j = np.triu_indices(len(grams), 1)
                    shared = (often[i] > 1) & (often[j] > 1)
                    i, j = i[shared], j[shared]
                    keys.append(mixed(mixed(grams[i]) + grams[j]))
                    at.append(i)
                if keys and (size := sum(map(len, keys))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.full(size, x)) for x in (doc, node, n)],
                         pa.array(np.concatenate(at))],
                        names=["key", "doc", "node", "n", "at"],
                    )

    return run


def _linked(similarity: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(texts_of(batch.column(2)), texts_of(batch.column(3)))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((merged[1:] == merged[:-1]).sum())
                keep[i] = similarity.linked(both, len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """Of the pairs (a, b) of nodes those that link, by their whole sets."""
    x = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_linked(similarity), "a bigint, b bigint")


def links(sets: DataFrame, similarity: Similarity, bits: int, rounds: int = 2) -> DataFrame:
    """(node, component) of nodes with a link; `sets` is (node, doc, n, grams), staged."""
    cells = frequencies(sets, bits)
    # One row per size class.
    rows = sets.select("n", "grams").mapInArrow(_costs(cells, similarity), "size int, subsets bigint, scanned bigint")
    summed = rows.groupBy("size").agg(F.sum("subsets").alias("a"), F.sum("scanned").alias("b")).collect()
    small = boundary({r["size"]: (r["a"], r["b"]) for r in summed}, similarity)
    lists = stage(
        sets.mapInArrow(_postings(cells, similarity, small), "key bigint, doc bigint, node bigint, n bigint, at bigint"),
        "postings",
    )
    several = stage(lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "keys")
    lists = stage(lists.join(several, "key"), "lists")
    found, labels, pivots = None, None, None
    for _ in range(rounds):
        open_ = lists if labels is None else _open(lists, labels)
        first = stage(open_.groupBy("key").agg(F.min(F.struct("doc", "node", "n", "at", *_label(open_))).alias("p")), "stars")
        star = open_.join(first, "key").where(F.col("node") != F.col("p.node"))
        if labels is not None:
            star = star.where(F.col("label") != F.col("p.label"))
        pairs = star.where(_possible("n", "at", "p.n", "p.at", similarity)).select(
            F.col("p.node").alias("a"), F.col("node").alias("b")
        ).distinct()
        new = stage(verified(pairs, sets, similarity), "links")
        found = new if found is None else found.unionByName(new)
        labels = stage(components(found), "labels")
    # What no star has settled: pairs of different components.
    rest = _open(lists, labels)
    x = rest.select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "at", "label")])
    open_pairs = (
        rest.join(x, "key")
        .where((F.col("node") < F.col("x_node")) & (F.col("label") != F.col("x_label")))
        .where(_possible("n", "at", "x_n", "x_at", similarity))
        .select(F.col("node").alias("a"), F.col("x_node").alias("b"))
        .distinct()
    )
    new = stage(verified(open_pairs, sets, similarity), "last-links")
    return labels if new.isEmpty() else stage(components(found.unionByName(new)), "labels")


def _label(lists: DataFrame) -> list[str]:
    return [c for c in lists.columns if c == "label"]


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of the lists that hold two components, with their component."""
    own = labels.select("node", F.col("component").alias("label"))
    named = stage(
        lists.join(own, "node", "left").withColumn("label", F.coalesce("label", "node")), "named"
    )
    mixed_ = stage(
        named.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("key"),
        "mixed-lists",
    )
    return named.join(mixed_, "key")


def _possible(n: str, at: str, m: str, bt: str, similarity: Similarity) -> Column:
    """Sizes fit, and enough n-grams are left from a shared one on, if it is the first shared one."""
    a, b = F.col(n), F.col(m)
    left = F.least(a - F.col(at), b - F.col(bt))
    return similarity.sizes_fit(a, b) & similarity.reachable(left, a, b)


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5,
    similarity: Similarity = Similarity(80, 100), bits: int = 26, cells: int = 22,
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row of `docs`.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. component_id is the
    smallest doc_id that links reach; texts without words link with nothing and have their own doc_id. A null
    text has no words; a null doc_id is larger than any other and is null only in a component of such. Equal
    rows get equal answers. Sets are compared by 64-bit hashes of their n-grams, equal
    sets by a 64-bit hash. `bits` and `cells` bound what is broadcast, whatever the number of rows.
    """
    own = F.col(f"`{id}`").cast("bigint")
    source = docs.select(
        F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(own, F.lit(LAST)).alias("doc"),
        F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"),
    )
    rows = _rows(source, k, similarity, bits)
    groups = stage(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")), "nodes"
    )
    # Copies of one node can be very many, its oldest document is one row.
    oldest = groups.select("node", "doc")
    nodes = rows.where("grams IS NOT NULL").join(oldest, ["node", "doc"]).select("node", "doc", "n", "grams")
    nodes = stage(nodes, "sets")
    flt = repeated_keys(nodes.select("grams"), _set_keys, bits)
    sets = stage(nodes.mapInArrow(_still(flt, similarity), "node bigint, doc bigint, n bigint, grams binary"), "candidates")
    if sets.isEmpty():
        linked = groups.select("node", F.col("node").alias("component")).limit(0)
    else:
        linked = links(sets, similarity, cells)
    member = linked.join(groups, "node")
    tops = member.groupBy("component").agg(F.min("doc").alias("top"))
    joined = member.join(tops, "component").select("node", "top")
    copies = groups.where("copies > 1").join(linked, "node", "left_anti").select("node", F.col("doc").alias("top"))
    answers = stage(joined.unionByName(copies), "answers")
    labelled = rows.select("doc", "text_hash", "n", "node").join(answers, "node", "left")
    return labelled.select(
        F.nullif("doc", F.lit(LAST)).alias("doc_id"),
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("top", "doc"), F.lit(LAST)).alias("component_id"),
    )


def _rows(source: DataFrame, k: int, similarity: Similarity, bits: int) -> DataFrame:
    flt = repeated_keys(source.select("text"), _low_keys(k), bits)
    return stage(source.mapInArrow(_sets(flt, k, similarity), "doc bigint, text_hash bigint, n bigint, node bigint, grams binary"), "rows")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""


@query("op7_ngram_jaccard_join", SQL)
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=4, similarity=Similarity(85, 100))
    return found.select("doc_id", "n_shingles", "component_id")
