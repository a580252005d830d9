"""Quality rules with thresholds that each language and source sets for itself.

Every text is measured once. Measures go into quantile sketches per language and source: counts of
logarithmic buckets, each 0.2 % wide, so a quantile is off by 0.1 % of itself at most, merging is
adding, and the result depends on no order. Sketches of sources merge to one per language and
one for all. A document's limits come from the finest level that holds enough documents,
and are joined to it.

No limit is a constant. Between its median and third quartile a sketch halves; if it goes on like that, fewer than one
document lies beyond the limit. Where the quartiles coincide (most texts have no symbol at all), the values beyond them are
taken instead. An empty stretch of a factor of two above the quartile ends the body earlier: what lies beyond
it is another kind of text. A share is known no better than the trials behind it allow: a document may exceed a limit
by three trials, the most that one would expect to miss where the true share is the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrows.llm.carried import kept_columns, restored
from strayrows.llm.registry import query, table
from strayrows.llm.words import Words, mixed, slices, texts_of, window_fits, windows
from strayrows.staging import stage

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """An upper limit on `measure`, a share of `trials` if that is given, and a lower one on request."""

    measure: str
    trials: str | None = None
    lower: bool = False


RULES = (
    Rule("chars_per_word", lower=True),
    Rule("symbols_per_word", "n_words"),
    Rule("dup_line_share", "n_lines"),
    Rule("repeat_share", "n_words"),
    Rule("upper_share", "n_letters"),
)
#: Trials that a document may be above a limit, and the factor that an empty stretch spans.
MISSED, STRETCH = 3, 2.0
SCHEMA = "key bigint, " + ", ".join(f"{c} bigint" for c in [*BASE, "n_lines", "n_upper", "n_letters"])


def _lines(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word, and of these the ones equal to an earlier line.

    Lines are equal byte for byte, white space included: a line's hash covers its span.
    """
    n_texts = len(words.first) - 1
    breaks = np.flatnonzero(words.data == 10)
    starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    has = np.searchsorted(words.starts, breaks) > np.searchsorted(words.starts, starts)
    starts, breaks = starts[has], breaks[has]
    doc = np.searchsorted(words.offsets, starts, side="right") - 1
    n_lines = np.bincount(doc, minlength=n_texts)
    keys = words.span_hashes(starts, breaks) ^ mixed(doc.astype(np.uint64))
    _, once = np.unique(keys, return_index=True)
    repeated = np.ones(len(keys), bool)
    repeated[once] = False
    return n_lines, np.bincount(doc[repeated], minlength=n_texts)


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of SCHEMA for each text; windows and lines are compared by 64-bit hashes."""
    words = Words(texts)
    n_texts, h = len(texts), words.hashes()
    doc = words.doc_of()
    counts = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.offsets])
    heads = (words.data & 0xC0) != 0x80
    black = np.diff(np.concatenate([[0], np.cumsum(heads)])[np.stack([words.starts, words.ends])], axis=0)
    fits = window_fits(words, 3)
    keys = windows(h, 3)[fits] ^ mixed(doc[: len(fits)][fits].astype(np.uint64))
    at = np.flatnonzero(fits)
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = at[times[back] >= 2]
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[twice + j] = True
    n_lines, dup = _lines(words, h)
    upper = (words.data >= 65) & (words.data <= 90)
    letters = upper | (words.data >= 97) & (words.data <= 122)
    return {
        "n_words": np.diff(words.first),
        "word_chars": np.bincount(doc, black[0], n_texts).astype(np.int64),
        "n_symbols": counts(_SYMBOL[words.data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc[covered], minlength=n_texts),
        "n_lines": n_lines,
        "n_upper": counts(upper),
        "n_letters": counts(letters),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(1))
        for a, b in slices(texts):
            found = {k: pa.array(v, pa.int64()) for k, v in measured(texts[a:b]).items()}
            names = SCHEMA.replace(" bigint", "").split(", ")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], *[found[n] for n in names[1:]], *[c[a:b] for c in batch.columns[2:]]],
                names=[*names, *batch.schema.names[2:]],
            )


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def quality(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    by: tuple[str, str] = ("lang", "source"),
    rules: tuple[Rule, ...] = RULES,
    least: int = 200,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, the columns `keep`, the counts of BASE, base_failed, kept.

    A document fails the base rules with fewer than 50 words or if more than half of its words
    lie in repeated windows. Sketches are taken of the documents that pass them. Levels with
    fewer than `least` such documents leave the decision to the next coarser one; if all
    documents together are fewer, only the base rules decide. A null text has no words; null
    language or source is a group of its own. Repeated rows are judged alike.
    """
    source = docs.select(
        F.col(f"`{id}`").cast("bigint").alias("key"),
        F.col(f"`{text}`").cast("string").alias("text"),
        *[F.col(f"`{c}`").cast("string").alias(f"g{i}") for i, c in enumerate(by)],
        *kept_columns(keep),
    )
    spec = f"{SCHEMA}, g0 string, g1 string"
    counts = stage(source.select("key", "text", "g0", "g1").mapInArrow(_measure, spec), "measures")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    derived = {
        "base_failed": base_failed,
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
    }
    rows = counts.withColumns(derived)
    limits = stage(_limits(rows.where(~F.col("base_failed")), rules, least), "limits")
    inside = F.lit(True)
    for r in rules:
        above = F.lit(0.0) if r.trials is None else MISSED / F.greatest(F.col(r.trials), F.lit(1))
        inside &= F.col(r.measure) <= F.col(f"{r.measure}_hi") + above
        if r.lower:
            inside &= F.col(r.measure) >= F.col(f"{r.measure}_lo")
    if keep:
        # Measured again beside the columns to keep: cheaper than moving whole texts to meet their measures.
        carried = [f"_keep_{c}" for c in keep]
        measured_type = T.StructType(
            T.StructType.fromDDL(spec).fields + [source.schema[c] for c in carried]
        )
        rows = source.mapInArrow(_measure, measured_type).withColumns(derived)
    d, t = rows.alias("d"), limits.alias("t")
    same = F.col("d.g0").eqNullSafe(F.col("t.g0")) & F.col("d.g1").eqNullSafe(F.col("t.g1"))
    return d.join(t, same, "left").select(
        F.col("key").alias("doc_id"),
        *restored(keep),
        *BASE,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


WIDTH = math.log(1.002)


def _tail(middle: float, quartile: float, n: int) -> float:
    """Where fewer than one of n documents lies beyond, if as many again are lost at each step of that size."""
    return quartile + (quartile - middle) * max(math.log(n / 4), 0.0) / math.log(2)


def limits_of(sketch: dict[str, tuple[np.ndarray, np.ndarray]], rules: tuple[Rule, ...]) -> dict[str, tuple[float, float]]:
    """(lower, upper) for each rule from (buckets, counts) of each measure, ascending; bucket NONE holds the zeros."""
    out = {}
    value = lambda b, at=0.5: 0.0 if b == NONE else math.exp((b - at) * WIDTH)
    quantile = lambda b, n, q: int(b[np.searchsorted(np.cumsum(n), q * n.sum())])
    for r in rules:
        buckets, counts = sketch[r.measure]
        n, (q1, q2, q3) = counts.sum(), (quantile(buckets, counts, q) for q in (0.25, 0.5, 0.75))
        limits = []
        for middle, quartile, beyond, far, end in ((q2, q1, buckets < q1, 0.25, 1), (q2, q3, buckets > q3, 0.75, 0)):
            rest = buckets[beyond], counts[beyond]
            if quartile != middle:
                limits.append(_tail(value(middle), value(quartile), n))
            elif beyond.any():
                limits.append(_tail(value(quantile(*rest, 0.5)), value(quantile(*rest, far)), rest[1].sum()))
            else:
                limits.append(value(quartile, end))
        low, high = limits
        # One hit in a text of middling length is the smallest share there is.
        least = NONE if r.trials is None else -quantile(*sketch[r.trials], 0.5)
        steps = np.maximum(buckets[buckets >= q3], least)
        wide = np.flatnonzero(np.diff(steps) * WIDTH >= math.log(STRETCH))
        if len(wide) and steps[wide[0]] > NONE:
            high = min(high, math.exp((steps[wide[0]] + steps[wide[0] + 1]) / 2 * WIDTH))
        out[r.measure] = low, high
    return out


#: Bucket of the zeros: below that of any double.
NONE = -(1 << 20)


def _limits(rows: DataFrame, rules: tuple[Rule, ...], least: int) -> DataFrame:
    """(g0, g1, <measure>_lo, <measure>_hi): one row per group, from the finest level with enough rows."""
    bucket = lambda m: F.when(F.col(m) > 0, F.ceil(F.log(m) / WIDTH)).otherwise(NONE).cast("bigint")
    named = [r.measure for r in rules] + sorted({r.trials for r in rules if r.trials})
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), bucket(m).alias("b")) for m in named]))
    fine = stage(
        rows.select("g0", "g1", values.alias("v"))
        .groupBy("g0", "g1", F.col("v.m").alias("m"), F.col("v.b").alias("b"))
        .agg(F.count("*").alias("n")),
        "sketches",
    )
    names = [f"{r.measure}_{side}" for r in rules for side in ("lo", "hi")]
    schema = "g0 string, g1 string, total bigint, " + ", ".join(f"{n} double" for n in names)

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        sketch = {}
        for m, own in frame.groupby("m"):
            own = own.sort_values("b")
            sketch[m] = own["b"].to_numpy(), own["n"].to_numpy()
        found = limits_of(sketch, rules)
        total = int(sketch[rules[0].measure][1].sum())
        cells = [x for r in rules for x in found[r.measure]]
        return pd.DataFrame([[frame["g0"].iloc[0], frame["g1"].iloc[0], total, *cells]], columns=["g0", "g1", "total", *names])

    groups = fine.select("g0", "g1").distinct().alias("f")
    none = F.lit(None).cast("string")
    levels = []
    for by in (["g0", "g1"], ["g0"], []):
        merged = fine.groupBy(*by, "m", "b").agg(F.sum("n").alias("n"))
        merged = merged.select(*[(F.col(g) if g in by else none).alias(g) for g in ("g0", "g1")], "m", "b", "n")
        # The buckets of a group, some hundreds for each measure.
        levels.append(merged.groupBy("g0", "g1").applyInPandas(decide, schema).where(F.col("total") >= least))
    f, c, e = (t.alias(n) for t, n in zip(levels, "hce"))
    chosen = (
        groups.join(f, F.col("f.g0").eqNullSafe(F.col("h.g0")) & F.col("f.g1").eqNullSafe(F.col("h.g1")), "left")
        .join(c, F.col("f.g0").eqNullSafe(F.col("c.g0")), "left")
        .join(F.broadcast(e), F.lit(True), "left")  # one row of fixed size
    )
    return chosen.select(
        F.col("f.g0").alias("g0"), F.col("f.g1").alias("g1"), *[F.coalesce(f"h.{n}", f"c.{n}", f"e.{n}").alias(n) for n in names]
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, lang AS g0, source AS g1, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, g0, g1, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN twice USING (doc_id)),
r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END,
     CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
     CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0 END] AS x FROM m),
b AS (
  SELECT g0, g1, k, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.002)) ELSE -1048576 END AS b
  FROM (SELECT g0, g1, unnest(list_concat(x, [n_words::DOUBLE, n_lines::DOUBLE, n_letters::DOUBLE])) AS x, unnest(range(1, 9)) AS k FROM r WHERE NOT base_failed)),
levels AS (
  SELECT 1 AS level, g0, g1, k, b FROM b UNION ALL SELECT 2, g0, NULL, k, b FROM b UNION ALL SELECT 3, NULL, NULL, k, b FROM b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, g0, g1, k ORDER BY b) AS i, count(*) OVER (PARTITION BY level, g0, g1, k) AS n
  FROM levels),
q AS (
  SELECT level, g0, g1, k, any_value(n) AS n, min(CASE WHEN i >= 0.25 * n THEN b END) AS b1, min(CASE WHEN i >= 0.5 * n THEN b END) AS b2,
         min(CASE WHEN i >= 0.75 * n THEN b END) AS b3 FROM ranked WHERE n >= 200 GROUP BY ALL),
beyond AS (
  SELECT q.level, q.g0, q.g1, q.k, t.b > q.b3 AS up, t.b, row_number() OVER (PARTITION BY q.level, q.g0, q.g1, q.k, t.b > q.b3 ORDER BY t.b) AS i,
         count(*) OVER (PARTITION BY q.level, q.g0, q.g1, q.k, t.b > q.b3) AS n
  FROM q JOIN ranked t ON t.level = q.level AND t.k = q.k AND t.g0 IS NOT DISTINCT FROM q.g0 AND t.g1 IS NOT DISTINCT FROM q.g1
    AND (t.b > q.b3 OR t.b < q.b1) WHERE q.k <= 5),
more AS (
  SELECT level, g0, g1, k, min(CASE WHEN up AND i >= 0.5 * n THEN b END) AS p2, min(CASE WHEN up AND i >= 0.75 * n THEN b END) AS p3,
         max(CASE WHEN up THEN n END) AS np, min(CASE WHEN NOT up AND i >= 0.25 * n THEN b END) AS l1,
         min(CASE WHEN NOT up AND i >= 0.5 * n THEN b END) AS l2, max(CASE WHEN NOT up THEN n END) AS nl FROM beyond GROUP BY ALL),
steps AS (
  SELECT q.level, q.g0, q.g1, q.k, greatest(t.b, coalesce(-u.b2, -1048576)) AS s
  FROM q JOIN (SELECT DISTINCT level, g0, g1, k, b FROM ranked) t
    ON t.level = q.level AND t.k = q.k AND t.g0 IS NOT DISTINCT FROM q.g0 AND t.g1 IS NOT DISTINCT FROM q.g1 AND t.b >= q.b3
  LEFT JOIN q u ON u.level = q.level AND u.g0 IS NOT DISTINCT FROM q.g0 AND u.g1 IS NOT DISTINCT FROM q.g1 AND u.k = [0, 6, 7, 6, 8][q.k]
  WHERE q.k <= 5),
gaps AS (
  SELECT level, g0, g1, k, min(exp((s + next) / 2 * ln(1.002))) AS edge, min(s) AS s FROM (
    SELECT *, lead(s) OVER (PARTITION BY level, g0, g1, k ORDER BY s) AS next FROM steps)
  WHERE (next - s) * ln(1.002) >= ln(2) AND s > -1048576 GROUP BY ALL),
own AS (
  SELECT q.*, edge, np, nl, CASE WHEN b1 > -1048576 THEN exp((b1 - 0.5) * ln(1.002)) ELSE 0 END AS q1, CASE WHEN b2 > -1048576 THEN exp((b2 - 0.5) * ln(1.002)) ELSE 0 END AS q2, CASE WHEN b3 > -1048576 THEN exp((b3 - 0.5) * ln(1.002)) ELSE 0 END AS q3, CASE WHEN p2 > -1048576 THEN exp((p2 - 0.5) * ln(1.002)) ELSE 0 END AS v2, CASE WHEN p3 > -1048576 THEN exp((p3 - 0.5) * ln(1.002)) ELSE 0 END AS v3, CASE WHEN l1 > -1048576 THEN exp((l1 - 0.5) * ln(1.002)) ELSE 0 END AS u1, CASE WHEN l2 > -1048576 THEN exp((l2 - 0.5) * ln(1.002)) ELSE 0 END AS u2,
         CASE WHEN b1 > -1048576 THEN exp((b1 - 1) * ln(1.002)) ELSE 0 END AS at1, CASE WHEN b3 > -1048576 THEN exp((b3 - 0) * ln(1.002)) ELSE 0 END AS at3
  FROM q LEFT JOIN more m ON m.level = q.level AND m.k = q.k AND m.g0 IS NOT DISTINCT FROM q.g0 AND m.g1 IS NOT DISTINCT FROM q.g1
  LEFT JOIN gaps g ON g.level = q.level AND g.k = q.k AND g.g0 IS NOT DISTINCT FROM q.g0 AND g.g1 IS NOT DISTINCT FROM q.g1 WHERE q.k <= 5),
edges AS (
  SELECT level, g0, g1, k,
         CASE WHEN b1 <> b2 THEN q1 + (q1 - q2) * greatest(ln(n / 4), 0) / ln(2)
              WHEN nl > 0 THEN u1 + (u1 - u2) * greatest(ln(nl / 4), 0) / ln(2) ELSE at1 END AS low,
         least(CASE WHEN b3 <> b2 THEN q3 + (q3 - q2) * greatest(ln(n / 4), 0) / ln(2)
               WHEN np > 0 THEN v3 + (v3 - v2) * greatest(ln(np / 4), 0) / ln(2) ELSE at3 END, coalesce(edge, 1e300)) AS high
  FROM own),
limits AS (
  SELECT r.doc_id, k, arg_min(low, level) AS low, arg_min(high, level) AS high
  FROM r JOIN edges q ON level = 3 OR q.g0 IS NOT DISTINCT FROM r.g0 AND (level = 2 OR q.g1 IS NOT DISTINCT FROM r.g1) GROUP BY ALL),
outside AS (
  SELECT r.doc_id, bool_or(x[k] > high + CASE WHEN k = 1 THEN 0 ELSE 3 / greatest([0, n_words, n_lines, n_words, n_letters][k], 1) END
                           OR k = 1 AND x[k] < low) AS out
  FROM r JOIN limits USING (doc_id) GROUP BY r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(out, false) AS kept
FROM r LEFT JOIN outside USING (doc_id)
"""


@query("op5_quality_rules", SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
