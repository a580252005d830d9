"""Substring dedup: matching statistics of documents against suffix automata of reference shards.

The reference of a document is every document with a smaller doc_id, so the reference is the corpus. Sending
each automaton to each document would cost documents x shards. Instead text is routed by
content: a window of `length` words belongs to its smallest hash among its runs of `gram` words (its
anchor), and neighbouring windows with one anchor form a segment. Equal windows have equal anchors, so an
automaton of an anchor's segments has to meet the segments of that anchor only.

1. Anchors in one document only cannot match: a filter of fixed size drops nearly all of them.
2. Remaining segments are reduced to distinct ones with their smallest doc_id, before and after a shuffle.
3. Per anchor, a suffix automaton over words is built from its distinct segments, oldest first, each state
   with the smallest doc_id of its occurrences. Segments stream through it; the state of the last
   `length` words gives the smallest doc_id of each window. Anchors with very many segments are
   split into their windows, which are counted by content instead.
4. Segments meet their occurrences again; windows with a smaller doc_id are spans to remove.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.carried import kept_columns, output_type, restored
from strayrows.llm.registry import query, table
from strayrows.llm.repeated import Filter, repeated_keys
from strayrows.llm.words import Words, slices, texts_of, window_fits, windows
from strayrows.staging import stage

#: Stands for a null doc_id, which is larger than any other.
LAST = (1 << 63) - 1


def anchors(words: Words, length: int, gram: int) -> np.ndarray:
    """Of each window of `length` words, the smallest hash of its runs of `gram` words."""
    low = windows(words.hashes(), gram)
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = low[:n].copy()
    for j in range(1, length - gram + 1):
        np.minimum(out, low[j : j + n], out=out)
    return out


def _anchor_keys(length: int, gram: int):
    def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        fits = window_fits(words, length)
        key, doc = anchors(words, length, gram)[fits], words.doc_of()[: len(fits)][fits]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[new], doc[new]

    return keys


def _segments(filter_, length: int, gram: int):
    """(anchor, segment, doc_id, text_hash, first, n) of the windows whose anchor may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*filter_.value)
        for batch in batches:
            texts = texts_of(batch.column(0))
            ids, marks = (batch.column(c).to_numpy() for c in (1, 2))
            for a, b in slices(texts):
                words = Words([b" ".join(t.split()) for t in texts[a:b]])
                fits = window_fits(words, length)
                key, doc = anchors(words, length, gram), words.doc_of()[: len(fits)]
                kept = fits & known.has(key)
                new = kept.copy()
                new[1:] &= ~kept[:-1] | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                run_of = np.cumsum(new)[kept] - 1
                n = np.bincount(run_of, minlength=len(first))
                last = first + n + length - 2
                buffer = words.data.tobytes()
                spans = zip(words.starts[first].tolist(), words.ends[last].tolist())
                own = doc[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[first].view(np.int64)),
                        pa.array([buffer[x:y] for x, y in spans], pa.binary()),
                        pa.array(ids[a:b][own]), pa.array(marks[a:b][own]),
                        pa.array(first - words.first[own]), pa.array(n.astype(np.int64)),
                    ],
                    names=["anchor", "segment", "doc_id", "text_hash", "first", "n"],
                )

    return run


class Automaton:
    """Suffix automaton over words of several segments, added with ascending doc_ids."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.doc = [-1], [0], [LAST]

    def _state(self, size: int, doc: int, like: int = -1) -> int:
        self.next.append(dict(self.next[like]) if like >= 0 else {})
        self.link.append(self.link[like] if like >= 0 else 0)
        self.size.append(size)
        self.doc.append(doc)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the strings of q that p leads to; they occur where q did, first in q's doc."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.doc[q], like=q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, word, q)
                continue
            state, p = self._state(self.size[last] + 1, doc), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            self.link[state] = 0 if p < 0 else self._split(p, word, self.next[p][word])
            last = state

    def oldest(self, words: list[bytes], length: int) -> list[int]:
        """Of each window of `length` of these words, the smallest doc_id it was added with.

        All of `words` must have been added; the matching statistic is cut to `length`.
        """
        state, out = 0, []
        for i, word in enumerate(words):
            state = self.next[state][word]
            while self.size[self.link[state]] >= length:
                state = self.link[state]
            if i >= length - 1:
                out.append(self.doc[state])
        return out


def oldest_of(segments: list[bytes], docs: list[int], length: int) -> list[list[int]]:
    """Of each window of each segment of one anchor, the smallest doc_id; one number if all agree."""
    if len(segments) == 1:
        return [[docs[0]]]
    machine, words = Automaton(), [s.split(b" ") for s in segments]
    for i in sorted(range(len(segments)), key=docs.__getitem__):
        machine.add(words[i], docs[i])
    found = [machine.oldest(w, length) for w in words]
    return [f if min(f) != max(f) else f[:1] for f in found]


def _oldest(length: int):
    """(segment_id, oldest) from rows (anchor, segment, doc_id) sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, segments, docs = None, [], []
        for batch in batches:
            ids, out = [], []

            def close():
                if segments:
                    ids.extend(segment_id(s) for s in segments)
                    out.extend(oldest_of(segments, docs, length))

            for a, s, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a != anchor:
                    close()
                    anchor, segments, docs = a, [], []
                segments.append(s)
                docs.append(d)
            yield _answers(ids, out)
        if segments:
            yield _answers([segment_id(s) for s in segments], oldest_of(segments, docs, length))

    return run


def _answers(ids: list[bytes], out: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["segment_id", "oldest"]
    )


def segment_id(segment: bytes) -> bytes:
    return hashlib.md5(segment, usedforsecurity=False).digest()


def _windows(length: int):
    """(segment, at, window, doc_id) of each window of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = segment.split(b" ")
                n = len(words) - length + 1
                for a in range(0, n, 10_000):
                    at = range(a, min(a + 10_000, n))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([segment_id(segment)] * len(at), pa.binary()), pa.array(at, pa.int64()),
                            pa.array([b" ".join(words[i : i + length]) for i in at], pa.binary()),
                            pa.array([doc] * len(at), pa.int64()),
                        ],
                        names=["segment_id", "at", "window", "doc_id"],
                    )

    return run


def repeated_spans(
    docs: DataFrame, length: int = 13, gram: int = 6, bits: int = 26, heavy: int = 2000
) -> DataFrame:
    """(doc_id, text_hash, spans) of the documents that repeat a window of a smaller doc_id.

    `docs` has text, doc_id and text_hash. `spans` are (first, n, oldest): `n` windows from word `first`
    and the smallest doc_id of each (one number if all agree). Anchors with more than `heavy` distinct
    segments take the way by windows; both ways give the same spans.
    """
    flt = repeated_keys(docs.select("text"), _anchor_keys(length, gram), bits)
    occurrences = stage(
        docs.mapInArrow(
            _segments(flt, length, gram),
            "anchor bigint, segment binary, doc_id bigint, text_hash bigint, first bigint, n bigint",
        ),
        "segments",
    )
    distinct = stage(
        occurrences.groupBy("anchor", "segment").agg(F.min("doc_id").alias("doc_id")), "distinct-segments"
    )
    crowded = stage(
        distinct.groupBy("anchor").count().where(F.col("count") > heavy).select("anchor"), "crowded-anchors"
    )
    light = (
        distinct.join(crowded, "anchor", "left_anti")
        .repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(_oldest(length), "segment_id binary, oldest array<bigint>")
    )
    single = stage(
        distinct.join(crowded, "anchor", "left_semi").select("segment", "doc_id")
        .mapInArrow(_windows(length), "segment_id binary, at bigint, window binary, doc_id bigint"),
        "heavy-windows",
    )
    first = stage(single.groupBy("window").agg(F.min("doc_id").alias("oldest")), "window-owners")
    split = single.join(first, "window").groupBy("segment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "oldest"))), lambda x: x["oldest"]).alias("oldest")
    )
    answers = stage(light.unionByName(split), "answers")
    # Both sides are plain scans, so that a segment shared by very many documents can be split.
    met = occurrences.select(
        F.unhex(F.md5("segment")).alias("segment_id"), "doc_id", "text_hash", "first", "n"
    ).join(answers, "segment_id")
    return (
        met.where(F.array_min("oldest") < F.col("doc_id"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("first", "n", "oldest")).alias("spans"))
    )


def removed(n_words: int, spans: list[dict], doc: int, length: int) -> np.ndarray:
    """Which words a document loses."""
    change = np.zeros(n_words + length + 1, np.int64)
    for s in spans:
        oldest = np.asarray(s["oldest"])
        at = s["first"] + (np.flatnonzero(oldest < doc) if len(oldest) > 1 else np.arange(s["n"]))
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
    return np.cumsum(change)[:n_words] > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _cleaned(length: int, layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(1).to_pylist()
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(texts_of(batch.column(0))):
                words, spans = text.split(), batch.column(2)[i].as_py()
                gone = removed(len(words), spans, doc[i], length) if spans else None
                n_words.append(len(words))
                n_removed.append(int(gone.sum()) if spans else 0)
                if layout:
                    kept.append(b"".join([w for w, g in zip(_WORD.findall(text), gone) if not g]) if spans else text)
                else:
                    kept.append(b" ".join([w for w, g in zip(words, gone) if not g]) if spans else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[3:], "n_words", "n_removed", "kept_text"],
            )

    return run


def substring_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
    length: int = 13, gram: int = 6, bits: int = 26, heavy: int = 2000, layout: bool = False,
) -> DataFrame:
    """doc_id, the columns `keep`, n_words, n_removed and kept_text of every row of `docs`.

    Words are runs of bytes other than space and 0x09-0x0D. A word goes if a window of `length`
    consecutive words around it also starts in a document with a smaller doc_id, all judged on the input.
    kept_text is what stays, joined by spaces, or with `layout` the text with its own white space
    (as it is where nothing goes). A null text has no words; a null doc_id counts as larger
    than any other; rows of one doc_id are never each other's reference, and rows that repeat
    doc_id and text get the same answer. Texts of fewer than `length` words lose nothing.
    """
    own = F.col(f"`{id}`").cast("bigint")
    source = docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(own, F.lit(LAST)).alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"),
        own.alias("_row_id"), *kept_columns(keep),
    )
    spans = stage(
        repeated_spans(source.select("text", "doc_id", "text_hash"), length, gram, bits, heavy), "spans"
    )
    extra = [c for c in source.columns if c not in ("text", "doc_id", "text_hash")]
    spec = output_type(source, extra, "n_words bigint, n_removed bigint, kept_text string")
    joined = source.join(spans, ["doc_id", "text_hash"], "left").select("text", "doc_id", "spans", *extra)
    return joined.mapInArrow(_cleaned(length, layout), spec).select(
        F.col("_row_id").alias("doc_id"), *restored(keep), "n_words", "n_removed", "kept_text"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM starts),
owners AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS p FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN owners USING (x) WHERE first < doc_id)
  GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(coalesce(p, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


@query("op1_substring_dedup", SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
