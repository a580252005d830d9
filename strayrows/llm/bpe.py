"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so. One pass counts chunks over all documents;
the shared ones are encoded once, by one task each, and travel as a table whose bytes are bounded. In a text, what lies
between shared chunks is encoded in one go, and so is a shared chunk that the table has no room for.

Either side of a join was encoded without the other. The join is repaired by encoding a window that reaches over it by some
words on each side. The window is right once it agrees with both sides: they end and begin with what
the window's own halves give, and its outermost words come out as they do there. Until then it grows, at last to the
whole text so far and the whole next part, which needs no agreement.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.registry import query, table
from strayrows.llm.words import Words, slices, texts_of
from strayrows.staging import stage

WINDOW = 16
#: Bytes of text that are encoded together.
SLICE = 1 << 20


def cuts(words: Words, mask: int) -> np.ndarray:
    """Positions in `words.data`, at starts of characters, where the hash of the bytes before hits."""
    total = np.arange(WINDOW, len(words.data))
    h = words.span_hashes(total - WINDOW, total)
    return total[((h & np.uint64(mask)) == 0) & ((words.data[WINDOW:] & 0xC0) != 0x80)]


def chunked(texts: list[bytes], mask: int) -> list[list[tuple[int, int]]]:
    """(start, end) of each chunk of each text; cuts depend on the text's own bytes only."""
    words = Words(texts)
    at, out = cuts(words, mask), []
    low = np.searchsorted(at, words.offsets[:-1] + WINDOW)
    high = np.searchsorted(at, words.offsets[1:] - 1)
    for i, t in enumerate(texts):
        own = (at[low[i] : high[i]] - words.offsets[i]).tolist()
        out.append(list(zip([0, *own], [*own, len(t)])) if t else [])
    return out


class WordMemo:
    """Ids of words met before, in flat arrays: the words of many texts are looked up at once, and a repeated word is
    encoded once. Words have 64-bit hashes for names, and their bytes are compared. Past `most` words it keeps those that
    several slices have met, or nothing if they are too many.
    """

    MARK = b"\x01"
    RUN = 64

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most
        self.mark = encode([self.MARK.decode()])[0]
        self.forget()

    def forget(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.rows = np.zeros((5, 0), np.int64)  # of each name: start and size of its ids, of its bytes, slices that met it
        self.ids, self.bytes = np.zeros(0, "<u4"), np.zeros(0, np.uint8)

    def shrink(self) -> None:
        kept = self.rows[4] > 1
        if 2 * kept.sum() > self.most:
            return self.forget()
        start, n_ids, byte, n_bytes, _ = rows = self.rows[:, kept]
        self.ids, self.bytes = self.ids[_runs(start, n_ids)], self.bytes[_runs(byte, n_bytes)]
        rows[0], rows[2], rows[4] = np.cumsum(n_ids) - n_ids, np.cumsum(n_bytes) - n_bytes, 1
        self.names, self.rows = self.names[kept], rows

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has: in runs with a mark between words, or one by one
        where the mark is no token of its own or occurs in a word."""
        if len(self.mark) == 1 and not any(self.MARK in w for w in words):
            between = b" " + self.MARK + b" "
            runs = [between.join(words[i : i + self.RUN]) + between for i in range(0, len(words), self.RUN)]
            flat = np.concatenate([np.array(x, "<u4") for x in self.encode([r.decode() for r in runs])])
            ends = np.flatnonzero(flat == self.mark[0])
            if len(ends) == len(words):
                return np.delete(flat, ends), np.diff(np.concatenate([[-1], ends])) - 1
        found = self.encode([w.decode() for w in words])
        return np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found], np.int64)

    def learn(self, words: Words, names: np.ndarray, at: np.ndarray) -> None:
        """Words `at` with names that are not known; ascending names."""
        starts, n_bytes = words.starts[at], words.ends[at] - words.starts[at]
        own = words.data[_runs(starts, n_bytes)]
        text, ends = own.tobytes(), np.cumsum(n_bytes).tolist()
        ids, n_ids = self.encoded([text[a:b] for a, b in zip([0, *ends], ends)])
        rows = np.stack([
            len(self.ids) + np.cumsum(n_ids) - n_ids, n_ids, len(self.bytes) + np.cumsum(n_bytes) - n_bytes, n_bytes, np.zeros_like(n_ids)
        ])
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, own])
        place = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, place, names)
        self.rows = np.insert(self.rows, place, rows, axis=1)

    def lookup(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """Ids of each text; None if two of the words share a name."""
        words = Words(texts)
        if not len(words):
            return [np.zeros(0, "<u4")] * len(texts)
        names, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.names) + len(names) > self.most:
            self.shrink()
        new = ~np.isin(names, self.names, assume_unique=True)
        if new.any():
            self.learn(words, names[new], first[new])
        own = np.searchsorted(self.names, names)
        self.rows[4, own] += 1
        start, n_ids, byte, n_bytes, _ = self.rows[:, own[which]]
        if not np.array_equal(n_bytes, words.ends - words.starts):
            return None
        if not np.array_equal(words.data[_runs(words.starts, n_bytes)], self.bytes[_runs(byte, n_bytes)]):
            return None
        ids = self.ids[_runs(start, n_ids)]
        ends = np.concatenate([[0], np.cumsum(n_ids)])[words.first[1:]]
        return np.split(ids, ends[:-1])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(before[-1] + sizes[-1])


class Encoder:
    """Encodes texts through a table of shared chunks: their bytes to their ids.

    With `memo`, long runs of text go through a WordMemo of that many words. It is for tokenizers
    that end a pre-token at white space, drop it and normalise nothing across it, as word_bpe does.
    """

    def __init__(self, spec: str, shared: dict[bytes, bytes] | None = None, memo: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.shared = shared or {}
        self.memo = WordMemo(lambda words: [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)], memo)

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """`plain`, through the memo if there is one."""
        found = self.memo.lookup(texts) if self.memo.most else None
        return self.plain(texts) if found is None else found

    def plain(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def parts(self, text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, bytes | None]]:
        """(start, end, ids if shared); what lies between shared chunks is one part."""
        out, open_from = [], 0
        for a, b in spans:
            ids = self.shared.get(text[a:b])
            if ids is not None:
                if a > open_from:
                    out.append((open_from, a, None))
                out.append((a, b, ids))
                open_from = b
        if open_from < len(text):
            out.append((open_from, len(text), None))
        return out

    def encode(self, texts: list[bytes], mask: int) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self.parts(t, s) if s else [] for t, s in zip(texts, chunked(texts, mask))]
        own = iter(self.many([t[a:b] for t, parts in zip(texts, cut) for a, b, ids in parts if ids is None]))
        out = []
        for text, parts in zip(texts, cut):
            ids = np.zeros(0, "<u4")
            for a, b, known in parts:
                more = next(own) if known is None else np.frombuffer(known, "<u4")
                ids = self.joined(text[:a], ids, text[a:b], more) if a else more
            out.append(ids.tobytes())
        return out

    def joined(self, left: bytes, left_ids: np.ndarray, right: bytes, right_ids: np.ndarray, words: int = 2) -> np.ndarray:
        """Ids of `left` + `right`, given those of each."""
        while True:
            a, b = _last_words(left, words), _first_words(right, words)
            if a == 0 and b == len(right):
                return self.plain([left + right])[0]
            tail, head = left[a:], right[:b]
            outer = (tail.split(maxsplit=1)[0] if a else b"", head.rsplit(maxsplit=1)[-1] if b < len(right) else b"")
            window, of_tail, of_head, first, last = self.plain([tail + head, tail, head, *outer])
            before, after = left_ids[: len(left_ids) - len(of_tail)], right_ids[len(of_head) :]
            if a:
                agrees = _starts(window, first) and _starts(of_tail, first) and _ends(left_ids, of_tail)
            else:
                agrees, before = True, left_ids[:0]
            if b < len(right):
                agrees = agrees and _ends(window, last) and _ends(of_head, last) and _starts(right_ids, of_head)
            else:
                after = right_ids[:0]
            if agrees:
                return np.concatenate([before, window, after])
            words *= 2


def _starts(ids: np.ndarray, with_ids: np.ndarray) -> bool:
    return np.array_equal(ids[: len(with_ids)], with_ids)


def _ends(ids: np.ndarray, with_ids: np.ndarray) -> bool:
    return np.array_equal(ids[len(ids) - len(with_ids) :], with_ids)


_WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def _last_words(text: bytes, n: int) -> int:
    """Where the last n words start and a cut-off one after them, if more lie before; else 0."""
    reach = 64 * n
    while True:
        at = max(len(text) - reach, 0)
        gaps = [m.end() for m in _WHITE.finditer(text, at) if m.start() > at or not at]
        if len(gaps) > n:
            return gaps[-n - 1]
        if not at:
            return 0
        reach *= 4


def _first_words(text: bytes, n: int) -> int:
    """Where the first n words end, with a cut-off one before them, if more follow; else the length."""
    reach = 64 * n
    while True:
        gaps = [m.start() for m in _WHITE.finditer(text, 0, reach) if m.end() < reach or reach >= len(text)]
        if len(gaps) > n:
            return gaps[n]
        if reach >= len(text):
            return len(text)
        reach *= 4


_last: dict[str, Encoder] = {}


def _kept(key: str, spec: str, shared: dict, memo: int) -> Encoder:
    """The encoder of an earlier task of the same call in this worker, with its memo."""
    if key not in _last:
        _last.clear()
        _last[key] = Encoder(spec, shared, memo)
    return _last[key]


def _counts(mask: int):
    """(h, n, doc_id, text_hash, start, length): chunks counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            texts = texts_of(batch.column(2))
            for a, b in slices(texts):
                words = Words(texts[a:b])
                edges = np.union1d(cuts(words, mask), words.offsets)
                edges = edges[edges <= words.offsets[-1]]
                doc = np.searchsorted(words.offsets, edges[:-1], side="right") - 1
                near = (edges[:-1] - words.offsets[doc] < WINDOW) & (edges[:-1] != words.offsets[doc])
                edges = np.delete(edges, np.flatnonzero(near))  # the window must lie within the text
                starts, ends = edges[:-1], edges[1:]
                doc = np.searchsorted(words.offsets, starts, side="right") - 1
                ends = np.minimum(ends, words.offsets[doc + 1] - 1)
                fits = ends > starts
                starts, ends, doc = starts[fits], ends[fits], doc[fits]
                h, at, n = np.unique(words.span_hashes(starts, ends), return_index=True, return_counts=True)
                own = a + doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(ids[own].astype(np.int64)), pa.array(hashes[own]),
                     pa.array(starts[at] - words.offsets[doc[at]]), pa.array(ends[at] - starts[at])],
                    names=["h", "n", "doc_id", "text_hash", "start", "length"],
                )

    return run


def shared_chunks(docs: DataFrame, spec: str, mask: int, table_bytes: int = 32 << 20) -> dict[bytes, bytes]:
    """Chunks that occur twice at least, encoded once: those whose repetition covers most bytes, until their texts and ids
    take `table_bytes` (ids counted as twice the text). What has no room is encoded where it is met.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    schema = "h bigint, n bigint, doc_id bigint, text_hash bigint, start bigint, length bigint"
    repeated = stage(
        known.select("doc_id", "text_hash", "text")
        .mapInArrow(_counts(mask), schema)
        .groupBy("h")
        .agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "length")).alias("at"))
        .where("n > 1")
        .select("h", ((F.col("n") - 1) * F.col("at.length")).alias("saves"), "at.*"),
        "shared-chunks",
    )
    # The bytes of chunks by what they save, in powers of two: some sixty numbers.
    power = F.log2("saves").cast("int")
    sizes = {r["p"]: r["b"] for r in repeated.groupBy(power.alias("p")).agg(F.sum(F.col("length") * 3 + 100).alias("b")).collect()}
    room, least = table_bytes, max(sizes, default=0) + 1
    for p in sorted(sizes, reverse=True):
        if sizes[p] > room:
            break
        room, least = room - sizes[p], p
    # Of the first power that doesn't fit, as many as do.
    rest = repeated.where(power == least - 1).orderBy(F.desc("saves"), "h").limit(max(room // 400, 0))
    chosen = stage(repeated.where(power >= least).unionByName(rest), "chosen-chunks")
    spans = chosen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec)
        for batch in batches:
            chunks = [
                text[s["start"] : s["start"] + s["length"]]
                for text, own in zip(texts_of(batch.column(0)), batch.column(1).to_pylist())
                for s in own
            ]
            ids = [x.tobytes() for x in encoder.plain(chunks)]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    # At most `table_bytes`, whatever the corpus: the spans are few, and so are the chunks.
    texts = known.join(F.broadcast(spans), ["doc_id", "text_hash"]).select("text", "spans")
    found = texts.mapInArrow(run, "chunk binary, ids binary").collect()
    return {bytes(r[0]): bytes(r[1]) for r in found}


def encode(
    docs: DataFrame, tokenizer_file: str, id: str = "doc_id", text: str = "text", mask: int = 511, memo: int = 0
) -> DataFrame:
    """(doc_id, ids, decoded) for every row: ids are little-endian 32-bit integers.

    `decoded` is made from the ids: their tokens joined by spaces, as a tokenizer without a decoder does. A
    null text is empty and has no ids. Rows that repeat a doc_id, with the same text or another, are rows like others, and
    so are those without one. No rows: no rows. Chunks average `mask` + 1 bytes; `memo` is as in Encoder.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    spec, size = tokenizer.to_str(), tokenizer.get_vocab_size(with_added_tokens=True)
    tokens = [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]
    source = docs.select(
        F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    context = docs.sparkSession.sparkContext
    fixed, key = context.broadcast((spec, tokens, shared_chunks(source, spec, mask))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, tokens, shared = fixed.value
        encoder = _kept(key, spec, shared, memo)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, SLICE):
                ids = encoder.encode(texts[a:b], mask)
                decoded = [b" ".join([tokens[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return source.mapInArrow(run, "doc_id bigint, ids binary, decoded string")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), memo=700_000)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
