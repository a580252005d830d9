"""Toxicity from a learned, weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes homoglyphs, digit substitutions, width, case and invisible characters, and
turns every other non-letter into a space. Weights are log odds of a word's document
frequency in toxic and other documents; phrases around a term that only other documents
contain are exceptions and cancel the term. Sums of weights, normalised by length, go through
a logistic curve fitted on documents whose words did not set the weights they are
scored with.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.folds import held_out, sampled
from strayrows.llm.registry import query, table
from strayrows.staging import stage

#: Look-alikes of Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁԛԝɡɩαβεικνορτυχ", "abekmhopctyxijsdqwgiabeiknoptux"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKC", chr(code)).casefold():
            c = SUBSTITUTES.get(c, HOMOGLYPHS.get(c, c))
            if unicodedata.category(c) not in ("Mn", "Cf"):
                out.append(c if c.isalpha() else " ")
        self[code] = "".join(out)
        return self[code]


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Letters and single spaces, with a space at both ends."""
    return f" {' '.join((text or '').translate(_FOLD).split())} "


class Matcher:
    """Terms with weights and exception phrases, all bounded by spaces."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.machine = ahocorasick.Automaton()
        for phrase in exceptions:
            self.machine.add_word(f" {phrase} ", (phrase, None))
        for term, weight in weights.items():
            if term not in exceptions:
                self.machine.add_word(f" {term} ", (term, weight))
        if weights or exceptions:
            self.machine.make_automaton()
        self.empty = not (weights or exceptions)

    def found(self, text: str) -> list[tuple[int, str, float]]:
        """(start, term, weight) of each term in folded text that no exception covers."""
        if self.empty:
            return []
        hits, spared = [], []
        for end, (phrase, weight) in self.machine.iter(text):
            start = end - len(phrase)
            if weight is None:
                spared.append((start, end))
            else:
                hits.append((start, phrase, weight))
        if not spared:
            return hits
        return [h for h in hits if not any(a <= h[0] and h[0] + len(h[1]) <= b for a, b in spared)]

    def features(self, text: str) -> tuple[float, float, float]:
        """Strongest weight, and the sum of weights per square root and per logarithm of length."""
        hits, n = self.found(text), text.count(" ") + 10
        total = sum(w for _, _, w in hits)
        return max((w for _, _, w in hits), default=0.0), total / math.sqrt(n), total / math.log(n)


def weights_of(counts: dict[str, tuple[int, int]], n_toxic: int, n_other: int, least_z: float = 2.0) -> dict[str, float]:
    """Log odds of words from (toxic, other) document counts, where they exceed their error."""
    out = {}
    for word, (toxic, other) in counts.items():
        w = math.log((toxic + 0.5) / (n_toxic + 1) * (n_other + 1) / (other + 0.5))
        if w > 0 and w / math.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)) >= least_z:
            out[word] = w
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, half, toxic, n): documents that hold a word, counted in the task first."""
    for batch in batches:
        counts: Counter = Counter()
        for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "toxic"))):
            counts.update((w, half, toxic) for w in set(folded(text).split()))
        words, halves, labels = zip(*counts) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(halves, pa.int32()), pa.array(labels, pa.int32()),
             pa.array(list(counts.values()), pa.int64())],
            names=["word", "half", "toxic", "n"],
        )


def _phrase_counts(terms: dict[str, float]):
    """(phrase, toxic, n): a term with the word before or after it, once per document."""

    def run(batches):
        matcher = Matcher(terms)
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic"))):
                flat, seen = folded(text), set()
                for start, term, _ in matcher.found(flat):
                    before = flat[:start].rpartition(" ")[2]
                    after = flat[start + len(term) + 2 :].partition(" ")[0]
                    seen |= {f"{before} {term}"} if before else set()
                    seen |= {f"{term} {after}"} if after else set()
                counts.update((p, toxic) for p in seen)
            phrases, labels = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(phrases, pa.string()), pa.array(labels, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["phrase", "toxic", "n"],
            )

    return run


def _features(matchers: list[tuple[dict, frozenset]]):
    def run(batches):
        built = [Matcher(*m) for m in matchers]
        for batch in batches:
            rows = [
                (*built[half].features(folded(text)), toxic)
                for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "toxic")))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [()] * 4)], names=["a", "b", "c", "y"]
            )

    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 30) -> np.ndarray:
    """Coefficients and, last, the intercept, by penalised Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


class Model:
    """A lexicon, its exceptions and the curve; small enough to travel with each task."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str], curve: list[float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    @classmethod
    def learned(
        cls, docs: DataFrame, labels: DataFrame, most: int = 40_000, terms: int = 20_000,
        exceptions: frozenset[str] = frozenset(),
    ) -> Model:
        """From at most `most` labelled documents outside the held-out fold; at most `terms` words.

        Labels of one doc_id that disagree count as toxic; null labels are left out. Without
        documents of both labels the lexicon is empty and every score is the toxic share.
        """
        truth = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.max(F.col("toxic").cast("int")).alias("toxic")
        )
        # At most `most` rows of two numbers.
        chosen = F.broadcast(sampled(truth, "doc_id", most))
        half = F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0, 0).otherwise(1)
        sample = stage(
            docs.join(chosen, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), half.alias("half"), "toxic")
            .dropDuplicates(["text"]),
            "toxicity-sample",
        )
        sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("half", "toxic").count().collect()}
        n = [sum(v for k, v in sizes.items() if k[1] == t) for t in (0, 1)]
        if not all(n):
            return cls({}, exceptions, [0.0, 0.0, 0.0, 30.0 if n[1] else -30.0])
        per = [F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)) for h in (0, 1) for t in (1, 0)]
        counted = (
            sample.mapInArrow(_word_counts, "word string, half int, toxic int, n bigint")
            .groupBy("word")
            .agg(*[c.alias(x) for c, x in zip(per, "abcd")])
            .where("a + c >= 2")
            .orderBy(F.desc((F.col("a") + F.col("c")) / (F.col("b") + F.col("d") + 1)), F.desc(F.col("a") + F.col("c")), "word")
            .limit(terms)
            .collect()
        )
        lexicon = lambda f, h: weights_of(
            {r["word"]: f(r) for r in counted}, sum(sizes.get((i, 1), 0) for i in h), sum(sizes.get((i, 0), 0) for i in h)
        )
        weights = lexicon(lambda r: (r["a"] + r["c"], r["b"] + r["d"]), (0, 1))
        phrases = (
            sample.mapInArrow(_phrase_counts(weights), "phrase string, toxic int, n bigint")
            .groupBy("phrase")
            .agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("o"))
            .where("t = 0 AND o >= 3")
            .orderBy(F.desc("o"), "phrase")
            .limit(terms)
            .collect()
        )
        exceptions = exceptions | {r["phrase"] for r in phrases}
        # Each half is scored with the words of the other one.
        other = [lexicon(lambda r: (r["c"], r["d"]), (1,)), lexicon(lambda r: (r["a"], r["b"]), (0,))]
        rows = np.array(sample.mapInArrow(
            _features([(w, exceptions) for w in other]), "a double, b double, c double, y double"
        ).collect())
        return cls(weights, exceptions, logistic(rows[:, :3], rows[:, 3]).tolist())

    def scores(self, docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
        """(doc_id, held_out, score, predicted, n_terms) for every row; a null text is empty."""
        model = docs.sparkSession.sparkContext.broadcast((self.weights, self.exceptions, self.curve))

        def run(batches):
            weights, exceptions, curve = model.value
            matcher = Matcher(weights, exceptions)
            for batch in batches:
                scores, hits = [], []
                for text in batch.column(1):
                    flat = folded(text.as_py())
                    z = sum(w * x for w, x in zip(curve, (*matcher.features(flat), 1.0)))
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                    hits.append(len(matcher.found(flat)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())],
                    names=["doc_id", "score", "n_terms"],
                )

        source = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        return source.mapInArrow(run, "doc_id bigint, score double, n_terms bigint").select(
            "doc_id", held_out("doc_id").alias("held_out"), "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms",
        )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Model.learned(docs, table(spark, sf_dir, "labels")).scores(docs)
