"""Quality rules, toxicity, languages: counts by hand, accuracy on held-out documents."""

import itertools
import os
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from strayrows.llm import language_id as L  # noqa: E402
from strayrows.llm import toxicity as T  # noqa: E402
from strayrows.llm.quality_rules import op5_quality_rules, quality  # noqa: E402
from strayrows.llm.toxicity import op2_toxicity  # noqa: E402

LABELLED = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(LABELLED), reason="no example tables")


def counted(df):
    return sorted(
        ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect()), key=repr
    )


def test_quality_counts(odd, odd_rows, make):
    found = quality(odd, keep=("text",))
    assert counted(found) == sorted(((i, *brute.quality_counts(t)) for i, t in odd_rows), key=repr)
    assert counted(quality(odd)) == counted(found)
    for r in found.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality(make([])).count() == 0


def test_quality_limits_adapt_to_the_group(make):
    """Symbols are usual in one source and odd in the other; a small source follows its language."""
    text = lambda i, mark: " ".join(f"word{(i * 7 + j) % 391}{mark if j % 3 == 0 else ''}" for j in range(60))
    rows = [(i, text(i, "|"), "en", "tables") for i in range(40)]
    rows += [(100 + i, text(i, ""), "en", "prose") for i in range(40)]
    rows += [(200, text(3, "|"), "en", "prose"), (201, text(3, "|"), "en", "tables"), (202, text(5, ""), None, None)]
    kept = {r.doc_id: r.kept for r in quality(make(rows), least=20).collect()}
    assert not kept[200] and kept[201] and kept[202]
    assert all(k for i, k in kept.items() if i < 200)


@needs_tables
def test_quality_rejects_junk_and_keeps_clean_documents(spark):
    found = op5_quality_rules(spark, LABELLED).join(spark.read.parquet(f"{LABELLED}/labels.parquet"), "doc_id")
    rows = found.where("NOT base_failed").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_folding():
    assert len(T.HOMOGLYPHS) == 31
    assert T.folded("Іdі0t, TR4SH!  ｓｃｕｍ​") == " idiot trash scum "
    assert T.folded(None) == "  " and T.folded("...") == "  "


def test_matching_with_exceptions():
    m = T.Matcher({"trash": 2.0, "bin": 1.0}, frozenset({"trash can", "the bin"}))
    assert [h[1] for h in m.found(T.folded("trash trash can, trash bin; the bin trashy"))] == ["trash", "trash", "bin"]
    assert T.Matcher({}).found(" a ") == []


def test_toxicity_of_odd_texts(spark, odd, odd_rows, make):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in odd_rows if i is not None] + [(None, 1), (8, None)], "doc_id bigint, toxic int")
    rows = T.Model.learned(odd.select("doc_id", "text"), labels).scores(odd).collect()
    assert sorted(r.doc_id or -1 for r in rows) == sorted(i or -1 for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    none = labels.limit(0)
    assert {r.predicted for r in T.Model.learned(odd.select("doc_id", "text"), none).scores(odd).collect()} == {0}
    assert T.Model.learned(make([]).select("doc_id", "text"), none).scores(make([])).count() == 0


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    found = op2_toxicity(spark, LABELLED).join(spark.read.parquet(f"{LABELLED}/labels.parquet"), "doc_id")
    rows = found.where("held_out").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit >= 0.5 * sum(r.toxic for r in rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.05 * len(rows)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 5, 3, 6, 0, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(first[-1], 3)).astype(np.float32)
    got = L.viterbi(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:]):
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=b - a)))
        assert value(got[a:b].tolist()) == pytest.approx(best, abs=1e-5)


LEARN = {
    "en": "the house and the garden with this thing that they were thinking of when the weather was",
    "de": "das haus und der garten mit diesem ding an das sie dachten als das wetter schön war",
    "ru": "дом и сад с этой вещью о которой они думали когда была хорошая погода",
}


def learned(make):
    rows = [(i, LEARN[lang], lang) for i, lang in enumerate(list(LEARN) * 20)]
    return L.Model.learned(make(rows))


def test_spans_of_mixed_texts(make):
    model = learned(make)
    texts = [
        (1, f"{LEARN['en']}. {LEARN['de']}. {LEARN['ru']}"), (2, "и"), (3, None), (4, "123 -- 456"), (5, ""), (6, "“” …"),
        (7, "ελληνικά"), (8, LEARN["de"] * 50), (None, LEARN["en"]),
    ]
    got = {r.doc_id: r for r in model.spans(make(texts)).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de", "ru"]
    assert sum(s.words for s in got[1].spans) == sum(len(t.split()) for t in LEARN.values())
    assert got[2].lang_pred == "ru"  # the script leaves one language
    assert {got[i].lang_pred for i in (3, 4, 5, 6)} == {"und"} and got[5].score == 0
    assert got[7].lang_pred in LEARN and got[8].lang_pred == "de" and got[None].lang_pred == "en"
    assert model.spans(make([])).count() == 0
    nothing = L.Model.learned(make([(1, None, None)]))
    assert {r.lang_pred for r in nothing.spans(make(texts)).collect()} == {"und"}


@needs_tables
def test_languages_of_held_out_documents(spark):
    found = L.op4_language_id(spark, LABELLED).join(spark.read.parquet(f"{LABELLED}/documents.parquet"), "doc_id")
    rows = found.where("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
