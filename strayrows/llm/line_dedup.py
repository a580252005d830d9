"""Line dedup with a deletion neighbourhood: equal lines and lines one word edit apart keep the earliest.

1. A line cut in half keeps one half through one edit. Lines none of whose halves, at any alignment, occurs in
   another line have no partner: filters of fixed size drop them, first over all lines, then over
   the distinct ones that are left.
2. Each remaining distinct line emits the hash of itself and of itself without each of its words, with the
   word's place. Lines with one hash and one place differ in that word; a line whose hash another line
   reaches by a deletion is that line without a word. There is no other way to be one edit apart,
   so every hash needs its earliest line only, not its pairs.
3. The earliest partner is verified by edit distance on the words, and decisions go back to all occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.carried import kept_columns, output_type, restored
from strayrows.llm.registry import query, table
from strayrows.llm.repeated import Filter, repeated_keys
from strayrows.llm.words import Runs, Words, lines, mixed, slices, texts_of
from strayrows.staging import stage

LAST = (1 << 63) - 1


def _halves(runs: Runs, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of both halves of each line, cut as a line of its length and as one a word longer."""
    n, out = end - start, []
    for more in (0, 1):
        size = n + more
        half = size // 2
        tag = mixed(size.astype(np.uint64))
        out.append(runs.hashes(start, start + half) ^ tag)
        out.append(runs.hashes(end - (size - half), end) ^ ~tag)
    return out


def _keys(least: int, near: int):
    def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        runs = Runs(words.hashes())
        start, end, _, _ = lines(words)
        keep = np.flatnonzero(end - start >= least)
        long = keep[end[keep] - start[keep] >= near]
        found = [runs.hashes(start[keep], end[keep]), *_halves(runs, start[long], end[long])]
        units = np.concatenate([keep, *[long] * 4])
        order = np.argsort(units, kind="stable")
        return np.concatenate(found)[order], units[order]

    return keys


def _candidates(flt, least: int, near: int):
    """(line, doc, text_hash, number): lines that may have a partner, white space as one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*flt.value)
        for batch in batches:
            texts = texts_of(batch.column(0))
            ids, marks = (batch.column(c).to_numpy() for c in (1, 2))
            for a, b in slices(texts):
                words = Words(texts[a:b])
                runs = Runs(words.hashes())
                start, end, doc, number = lines(words)
                hit = known.has(runs.hashes(start, end))
                long = np.flatnonzero(end - start >= near)
                for half in _halves(runs, start[long], end[long]):
                    hit[long] |= known.has(half)
                at = np.flatnonzero(hit & (end - start >= least))
                buffer = words.data.tobytes()
                spans = zip(words.starts[start[at]].tolist(), words.ends[end[at] - 1].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b" ".join(buffer[x:y].split()) for x, y in spans], pa.binary()),
                        pa.array(ids[a:b][doc[at]]), pa.array(marks[a:b][doc[at]]), pa.array(number[at]),
                    ],
                    names=["line", "doc", "text_hash", "number"],
                )

    return run


def _variants(flt, near: int):
    """(v, at, doc, text_hash, number): hashes of a line without the word `at`, and with at = -1 of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*flt.value)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts, 1 << 18):
                words = Words(texts[a:b])
                runs = Runs(words.hashes())
                start, end, line, _ = lines(words)
                hit = np.zeros(len(start), bool)
                for half in _halves(runs, start, end):
                    hit |= known.has(half)
                hit &= end - start >= near
                start, end, line = start[hit], end[hit], line[hit]
                n = end - start
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                v = np.concatenate([runs.without(start[which], end[which], at), runs.hashes(start, end)])
                place = np.concatenate([at, np.full(len(n), -1)])
                row = np.concatenate([line[which], line])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.view(np.int64)), pa.array(place), *[c[a:b].take(pa.array(row)) for c in batch.columns[1:]]],
                    names=["v", "at", *batch.schema.names[1:]],
                )

    return run


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is put in, left out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (texts_of(batch.column(c)) for c in ("line", "partner"))
        fine = [one_edit(p.split(b" "), q.split(b" ")) for p, q in zip(x, y)]
        yield batch.select(["line", "best"]).filter(pa.array(fine, pa.bool_()))


def _own() -> Column:
    return F.struct("doc", "text_hash", "number")


def earliest_lines(docs: DataFrame, least: int, near: int, bits: int) -> DataFrame:
    """(doc, text_hash, numbers): the lines of each document that an earlier line repeats."""
    flt = repeated_keys(docs.select("text"), _keys(least, near), bits)
    found = stage(
        docs.mapInArrow(_candidates(flt, least, near), "line binary, doc bigint, text_hash bigint, number bigint"),
        "candidate-lines",
    )
    distinct = stage(found.groupBy("line").agg(F.min(_own()).alias("own")), "distinct-lines")
    flt = repeated_keys(distinct.select("line"), _keys(near, near), bits)
    variants = stage(
        distinct.select("line", "own.*").mapInArrow(
            _variants(flt, near), "v bigint, at bigint, doc bigint, text_hash bigint, number bigint"
        ),
        "variants",
    )
    # The earliest line of each hash and place; then of each hash, among whole lines and among shortened ones.
    at_place = stage(
        variants.groupBy("v", "at").agg(F.min(_own()).alias("place_best"), F.count("*").alias("n")), "places"
    )
    of_hash = at_place.groupBy("v").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("at") < 0, F.col("place_best"))).alias("whole"),
        F.min(F.when(F.col("at") >= 0, F.col("place_best"))).alias("shorter"),
    ).where("n > 1")
    met = stage(at_place.drop("n").join(of_hash.drop("n"), "v"), "met")
    best = variants.join(met, ["v", "at"]).select(
        _own().alias("own"),
        F.when(F.col("at") < 0, F.col("shorter")).otherwise(F.least("place_best", "whole")).alias("best"),
    ).where("best < own").groupBy("own").agg(F.min("best").alias("best"))
    partner = distinct.select(F.col("line").alias("partner"), F.col("own").alias("best"))
    checked = distinct.join(best, "own").join(partner, "best").select("line", "partner", "best")
    near_best = stage(
        checked.mapInArrow(_verified, "line binary, best struct<doc:bigint,text_hash:bigint,number:bigint>"), "near-lines"
    )
    owners = stage(
        distinct.join(near_best, "line", "left").select(
            F.unhex(F.md5("line")).alias("line_id"), F.coalesce("best", "own").alias("owner")
        ),
        "line-owners",
    )
    # Both sides are plain scans, so that a line of very many documents can be split.
    occurrences = found.select(F.unhex(F.md5("line")).alias("line_id"), _own().alias("here"))
    return (
        occurrences.join(owners, "line_id").where("owner < here")
        .groupBy("here.doc", "here.text_hash").agg(F.collect_list("here.number").alias("numbers"))
    )


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_removed, kept = [], [], []
        for text, gone in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
            parts, gone = text.split(b"\n"), set(gone or ())
            n_lines.append(sum(1 for p in parts if p.split()))
            n_removed.append(len(gone))
            kept.append(b"\n".join([p for i, p in enumerate(parts) if i not in gone]) if gone else text)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*batch.schema.names[2:], "n_lines", "n_removed", "kept_text"],
        )


def line_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
    least: int = 3, near: int = 10, bits: int = 26,
) -> DataFrame:
    """doc_id, the columns `keep`, n_lines, n_removed and kept_text of every row of `docs`.

    A line is what line feeds separate; its words are runs of bytes other than space and 0x09-0x0D. A line goes if an
    earlier line, by (doc_id, text hash, place), has the same words, or, where both have `near` words at least,
    differs in one word put in, left out or replaced. All lines are judged on the input, removed ones
    included. Lines of fewer than `least` words stay: they separate and head. A null text has no
    line and is kept as empty text, a null doc_id comes last, and rows that repeat doc_id and text get the same
    answer (they are not each other's earlier line). n_lines counts lines with a word.
    """
    own = F.col(f"`{id}`").cast("bigint")
    source = docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(own, F.lit(LAST)).alias("doc"),
        F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"),
        own.alias("_row_id"), *kept_columns(keep),
    )
    gone = stage(earliest_lines(source.select("text", "doc", "text_hash"), least, near, bits), "removed-lines")
    extra = [c for c in source.columns if c not in ("text", "doc", "text_hash")]
    joined = source.join(gone, ["doc", "text_hash"], "left").select("text", "numbers", *extra)
    spec = output_type(source, extra, "n_lines bigint, n_removed bigint, kept_text string")
    cleaned = joined.mapInArrow(_without_lines, spec)
    return cleaned.select(
        F.col("_row_id").alias("doc_id"), *restored(keep), "n_lines", "n_removed", "kept_text"
    )


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, i, list_filter(string_split_regex(parts[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
l AS (SELECT doc_id, i, w, array_to_string(w, ' ') AS t, {'d': doc_id, 'i': i} AS here FROM lines WHERE len(w) >= 3),
same AS (SELECT t, any_value(w) AS w, min(here) AS own FROM l GROUP BY t),
long AS (SELECT t, w, own, unnest(range(1, len(w) + 1)) AS p FROM same WHERE len(w) >= 10),
cut AS (SELECT t, own, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS v FROM long),
replaced AS (SELECT t, min(m) AS m FROM (SELECT t, min(own) OVER (PARTITION BY v, p) AS m FROM cut) GROUP BY t),
added AS (SELECT cut.t, min(same.own) AS m FROM cut JOIN same ON cut.v = same.t WHERE len(same.w) >= 10 GROUP BY cut.t),
lacking AS (SELECT same.t, min(cut.own) AS m FROM same JOIN cut ON cut.v = same.t WHERE len(same.w) >= 10 GROUP BY same.t),
owners AS (
  SELECT t, min(m) AS owner FROM (
    SELECT t, own AS m FROM same UNION ALL FROM replaced UNION ALL FROM added UNION ALL FROM lacking) GROUP BY t),
gone AS (SELECT doc_id, list(i) AS p FROM l JOIN owners USING (t) WHERE owner < here GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM lines x WHERE x.doc_id = d.doc_id AND len(x.w) > 0) AS n_lines, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string(list_filter(parts, lambda v, i: NOT list_contains(coalesce(p, []), i)), chr(10))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
