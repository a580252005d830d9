"""Languages of mixed texts: scripts narrow the candidates, Viterbi over words labels spans.

A word's score for a language is the sum of log-probabilities of its byte trigrams, limited so that no
single word decides. Languages that never use a word's script are out. The best path of
labels pays a penalty for each switch. All words of a batch are scored as NumPy arrays, and the paths
of all its texts are advanced together, one word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.folds import held_out, sampled
from strayrows.llm.registry import query, table
from strayrows.llm.words import slices
from strayrows.staging import stage

BITS = 15
#: First code points of script blocks and a name for each; Latin is what comes before Greek.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Han"),
)
_NAMES = sorted({n for _, n in SCRIPTS})
_FIRST = np.array([c for c, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def lowered(column: pa.Array) -> list[bytes]:
    return [(x or "").lower().encode() for x in column.to_pylist()]


class Spelled:
    """Words (runs of letters) of lower-case texts; trigrams and scripts as arrays."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" " + b" ".join([*texts, b" "]), np.uint8).copy()
        letter = _LETTER[data]
        data[~letter] = 32
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
        self.first = np.searchsorted(self.starts, offsets)
        d = data.astype(np.uint32)
        key = d[:-2] | (d[1:-1] << 8) | (d[2:] << 16)
        key *= np.uint32(0x9E3779B1)
        self.trigram = np.concatenate([[0], key >> np.uint32(32 - BITS), [0]]).astype(np.int32)
        self.letter = letter
        lead = data[self.starts].astype(np.int64)
        tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        c1, c2 = tail[self.starts + 1] & 63, tail[self.starts + 2] & 63
        code = np.where(lead < 0xC0, lead, np.where(lead < 0xE0, (lead & 31) << 6 | c1, (lead & 15) << 12 | c1 << 6 | c2))
        code = np.where(lead >= 0xF0, 0x20000, code)
        self.script = _SCRIPT[np.searchsorted(_FIRST, code, side="right") - 1]


def _train(n_langs: int):
    """(kind, lang, cell, n): trigrams (kind 0) and scripts (kind 1) of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((n_langs, 1 << BITS), np.int64)
        scripts = np.zeros((n_langs, len(_NAMES)), np.int64)
        for batch in batches:
            texts, langs = lowered(batch.column(0)), batch.column(1).to_numpy()
            for lang in np.unique(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for a, b in slices(own):
                    s = Spelled(own[a:b])
                    grams[lang] += np.bincount(s.trigram[s.letter], minlength=1 << BITS)
                    scripts[lang] += np.bincount(s.script, minlength=len(_NAMES))
        for kind, counts in enumerate((grams, scripts)):
            lang, cell = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lang), kind), pa.int32()), pa.array(lang, pa.int32()), pa.array(cell, pa.int32()),
                 pa.array(counts[lang, cell], pa.int64())],
                names=["kind", "lang", "cell", "n"],
            )

    return run


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words first[i]:first[i + 1] of each text i.

    Of equal paths, staying wins over switching, then the first label. Texts are advanced in step, longest
    first, so at each step the ones still running are a leading block.
    """
    labels = np.zeros(len(scores), np.int64)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return labels
    start, lengths = first[:-1][order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    value = scores[start].copy()
    best, switched = [], []
    for t in range(1, lengths[0]):
        n = running[t]
        v = value[:n]
        top = v.argmax(axis=1)
        rival = v[np.arange(n), top][:, None] - penalty
        switch = v < rival
        value[:n] = np.where(switch, rival, v) + scores[start[:n] + t]
        best.append(top.astype(np.uint8))
        switched.append(switch)
    now = value.argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        n = running[t]
        labels[start[:n] + t] = now[:n]
        if t:
            jump = switched[t - 1][np.arange(n), now[:n]]
            now[:n] = np.where(jump, best[t - 1], now[:n])
    return labels


class Model:
    """Log-probabilities of trigram cells and allowed scripts of each language, of fixed size."""

    def __init__(self, langs: list[str], grams: np.ndarray, allowed: np.ndarray):
        self.langs, self.grams, self.allowed = langs, grams, allowed

    @classmethod
    def learned(cls, docs: DataFrame, most: int = 40_000, most_langs: int = 250, rare: float = 0.001) -> Model:
        """From at most `most` documents with a language outside the held-out fold.

        The `most_langs` most frequent languages of this sample are learned. A script belongs to
        a language if at least the share `rare` of its words uses it.
        """
        known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
        # At most `most` identifiers.
        chosen = F.broadcast(sampled(known.select("doc_id"), "doc_id", most).distinct())
        sample = stage(known.join(chosen, "doc_id").select("text", "lang"), "language-sample")
        counted = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
        langs = sorted(r["lang"] for r in counted)
        if not langs:
            return cls([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
        index = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
        rows = (
            sample.select("text", index.alias("lang")).where("lang >= 0")
            .mapInArrow(_train(len(langs)), "kind int, lang int, cell int, n bigint")
            .groupBy("kind", "lang", "cell").agg(F.sum("n").alias("n"))
            .collect()  # languages x cells at most
        )
        grams, scripts = np.zeros((1 << BITS, len(langs))), np.zeros((len(_NAMES), len(langs)))
        for kind, lang, cell, n in rows:
            (scripts if kind else grams)[cell, lang] = n
        share = (grams + 0.5) / (grams + 0.5).sum(axis=0)
        return cls(langs, np.log(share).astype(np.float32), scripts >= rare * scripts.sum(axis=0).clip(1))

    def word_scores(self, spelled: Spelled, limit: float) -> np.ndarray:
        """Log-probabilities less the word's best one, at least -limit; -4 * limit for other scripts.

        A script that no language uses leaves all candidates in.
        """
        total = np.zeros((len(spelled.starts), len(self.langs)), np.float32)
        if not total.size:
            return total
        for j in range(len(self.langs)):  # one language at a time keeps the temporary arrays short
            logs = np.where(spelled.letter, self.grams[spelled.trigram, j], 0)
            total[:, j] = np.add.reduceat(logs, spelled.starts)
        allowed = self.allowed[spelled.script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        total[~allowed] = -np.inf
        total -= total.max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(total, -limit), -4 * limit).astype(np.float32)

    def spans(
        self, docs: DataFrame, id: str = "doc_id", text: str = "text", penalty: float = 12.0, limit: float = 6.0,
        with_spans: bool = True,
    ) -> DataFrame:
        """(doc_id, lang_pred, score, n_spans, spans) for every row.

        `spans` are (first word, words, lang) runs of one label, words being runs of letters. lang_pred has the most
        letter bytes, ties go to the first language by name; score is its share of them. Null texts,
        texts without a letter, and all texts where nothing could be learned are `und`, score 0.
        """
        model = docs.sparkSession.sparkContext.broadcast((self.langs, self.grams, self.allowed))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(*model.value)
            names = np.array([*own.langs, "und"], dtype=object)
            for batch in batches:
                strings = batch.column(1).to_pylist()
                texts = [(x or "").lower().encode() for x in strings]
                for a, b in slices(texts, max(1 << 20, (32 << 20) // max(len(own.langs), 4))):
                    labels, weight, first = own.labelled(texts[a:b], penalty, limit)
                    pred, score, n_spans, spans = _summary(labels, weight, first, len(own.langs))
                    for i in np.flatnonzero(score > 0):
                        if not any(c.isalpha() for c in strings[a + i]):
                            pred[i], score[i] = -1, 0.0
                    none = (score == 0) | (len(own.langs) == 0)
                    pred[none] = len(own.langs)
                    listed = [
                        [{"first": f, "words": w, "lang": names[x]} for f, w, x in s] if with_spans and not n else []
                        for s, n in zip(spans, none)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[a:b], pa.array(names[pred], pa.string()), pa.array(np.where(none, 0.0, score)),
                         pa.array(np.where(none, 0, n_spans), pa.int64()), pa.array(listed, kind)],
                        names=["doc_id", "lang_pred", "score", "n_spans", "spans"],
                    )

        source = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        return source.mapInArrow(
            run, "doc_id bigint, lang_pred string, score double, n_spans bigint, "
            "spans array<struct<first:bigint,words:bigint,lang:string>>"
        )

    def labelled(self, texts: list[bytes], penalty: float, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels and lengths of all words, and where each text's words begin."""
        scores, weight, first = [], [], [np.zeros(1, np.int64)]
        for a, b in slices(texts):
            s = Spelled(texts[a:b])
            scores.append(self.word_scores(s, limit))
            weight.append(s.ends - s.starts)
            first.append(first[-1][-1] + s.first[1:])
        first = np.concatenate(first)
        if not self.langs or not scores:
            return np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64), first
        return viterbi(np.concatenate(scores), first, penalty), np.concatenate(weight), first


def _summary(labels, weight, first, n_langs):
    """Of each text: label with most weight, its share, number of label runs, and the runs."""
    n_texts = len(first) - 1
    doc = np.repeat(np.arange(n_texts), np.diff(first))
    per = np.bincount(doc * max(n_langs, 1) + labels, weight, n_texts * max(n_langs, 1)).reshape(n_texts, -1)
    pred, total = per.argmax(axis=1), per.sum(axis=1)
    score = np.divide(per.max(axis=1), total, out=np.zeros(n_texts), where=total > 0)
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(labels)))
    n_spans = np.bincount(doc[at], minlength=n_texts)
    ends = np.concatenate([[0], np.cumsum(n_spans)])
    runs = np.column_stack([at - first[doc[at]], sizes, labels[at]]).tolist() if len(at) else []
    return pred, score, n_spans, [runs[a:b] for a, b in zip(ends[:-1], ends[1:])]


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = Model.learned(docs).spans(docs, with_spans=False)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_spans")
