"""All stages of the pipeline, one after the other, against plain versions of them."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

import corpus_pipeline as P  # noqa: E402


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)


def check_stages(spark, docs):
    columns = docs.columns
    kept = P.quality_rules(spark, docs, "").cache()
    assert kept.columns == columns and set(kept.collect()) <= set(docs.collect())
    lined = P.dedup_lines(spark, kept, "").cache()
    rows = rows_of(kept)
    want = [
        (i, t) for (i, n, t), (_, before) in zip(brute.lines(rows, 3, 10), rows) if n == 0 or brute.words(t)
    ]
    assert lined.columns == columns and rows_of(lined) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.text is not None)
    joined = P.join_ngrams(spark, lined, "").cache()
    rows = rows_of(lined)
    want = {(i, t) for (i, t), (_, _, c) in zip(rows, brute.components(rows, 5, 80, 100)) if i == c}
    assert joined.columns == columns and rows_of(joined) == sorted(want, key=repr)
    cut = P.dedup_substrings(spark, joined, "").cache()
    rows = rows_of(joined)
    got = sorted(((r.doc_id, brute.words(r.text)) for r in cut.collect()), key=repr)
    want = [
        (i, t.encode().split()) for (i, n, t), (_, before) in zip(brute.substring(rows, 13), rows) if t or not brute.words(before)
    ]
    assert cut.columns == columns and got == sorted(want, key=repr)
    packed = P.packing(spark, cut, "")
    assert packed.groupBy().sum("n_tokens").first()[0] == sum(len(w) for _, w in got)
    return packed


def test_stages_on_documents(spark, small_documents):
    packed = check_stages(spark, small_documents)
    again = P.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(repr, packed.collect())) == sorted(map(repr, again.collect()))


def test_stages_on_odd_documents(spark, odd):
    check_stages(spark, odd)


def test_stages_without_documents(spark, make):
    docs = make([])
    for _, function in P.STAGES:
        docs = function(spark, docs, "")
        assert docs.count() == 0
