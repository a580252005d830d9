"""Exact, substring, line and near-duplicate operators against plain versions."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from strayrows.llm import substring_dedup as S  # noqa: E402
from strayrows.llm.components import components  # noqa: E402
from strayrows.llm.exact_dedup import exact_dedup  # noqa: E402
from strayrows.llm.line_dedup import line_dedup, one_edit  # noqa: E402
from strayrows.llm.ngram_join import Similarity, boundary, near_duplicates  # noqa: E402


def listed(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_exact(odd, odd_rows, make):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert listed(exact_dedup(odd), *names) == brute.exact(odd_rows)
    assert exact_dedup(make([])).count() == 0


def test_exact_where_chunks_share_hashes(odd, odd_rows):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert listed(exact_dedup(odd, chunk_hash=weak), *names) == brute.exact(odd_rows)


@pytest.mark.parametrize("heavy", [2000, 0])
def test_substring(odd, odd_rows, make, heavy):
    found = S.substring_dedup(odd, keep=("n_words",), bits=16, heavy=heavy)
    assert found.columns == ["doc_id", "n_words", "n_words", "n_removed", "kept_text"]
    got = sorted(((r[0], r[2], r[4]) for r in found.collect()), key=repr)
    assert got == sorted(brute.substring(odd_rows, 13), key=repr)
    assert S.substring_dedup(make([]), bits=16).count() == 0


def test_substring_keeps_layout(make):
    text = "a1 a2\n\na3  a4 a5"
    rows = [(1, "b1 " + text), (2, text), (3, "c1\tc2 " + text + " c3\nc4")]
    got = {r.doc_id: r.kept_text for r in S.substring_dedup(make(rows), length=4, gram=2, bits=16, layout=True).collect()}
    assert got == {1: "b1 " + text, 2: "", 3: "c1\tc2 c3\nc4"}


def test_substring_on_documents(small_documents):
    got = listed(S.substring_dedup(small_documents, bits=20), "doc_id", "n_words", "kept_text")
    assert got == sorted(brute.substring(pairs(small_documents), 13), key=repr)


def test_automaton_finds_the_oldest_owner_of_each_window():
    segments = [b"a b c d e", b"b c d e f", b"c d e a b c", b"a a a a a"]
    docs = [7, 3, 5, 9]
    got = S.oldest_of(segments, docs, 3)
    whole = {}
    for s, d in zip(segments, docs):
        w = s.split()
        for i in range(len(w) - 2):
            whole[tuple(w[i : i + 3])] = min(d, whole.get(tuple(w[i : i + 3]), 99))
    for s, g in zip(segments, got):
        w = s.split()
        want = [whole[tuple(w[i : i + 3])] for i in range(len(w) - 2)]
        assert (g if len(g) > 1 else g * len(want)) == want


def test_lines(odd, odd_rows, make):
    got = listed(line_dedup(odd, keep=("doc", "key"), bits=16), "doc_id", "n_removed", "kept_text")
    assert got == sorted(brute.lines(odd_rows, 3, 10), key=repr)
    assert line_dedup(make([]), bits=16).count() == 0


def test_lines_one_edit_apart(make):
    base = [f"w{i}" for i in range(11)]
    put = base[:4] + ["new"] + base[4:]
    out = base[:7] + base[8:]
    other = ["x", *base[1:]]
    two = ["y", *base[1:-1], "z"]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, put, out, other, two, base, base[:9], ["x"] + base[1:9]])]
    got = {r.doc_id: r.n_removed for r in line_dedup(make(rows), bits=16).collect()}
    assert got == {d: n for d, n, _ in brute.lines(rows, 3, 10)}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0}
    assert one_edit(base, put) and one_edit(put, base) and not one_edit(put, out)


def test_lines_on_documents(small_documents):
    got = listed(line_dedup(small_documents, bits=20), "doc_id", "n_removed", "kept_text")
    assert got == sorted(brute.lines(pairs(small_documents), 3, 10), key=repr)


@pytest.mark.parametrize("k,part,whole", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_near_duplicates(odd, odd_rows, make, k, part, whole):
    found = near_duplicates(odd, k=k, similarity=Similarity(part, whole), bits=16, cells=12)
    assert listed(found, "doc_id", "n_shingles", "component_id") == sorted(brute.components(odd_rows, k, part, whole), key=repr)
    assert near_duplicates(make([]), bits=16, cells=12).count() == 0


def test_near_duplicates_in_chains_and_of_all_sizes(make):
    """Chains of small edits (ends do not link), sets around the boundary of sizes, and families."""
    rows, n = [], 0
    for size in (6, 7, 8, 12, 20, 33, 60, 120):
        words = [f"s{size}w{i}" for i in range(size)]
        for step in range(9):
            words = [*words[1:], f"s{size}n{step}"] if step % 3 else list(words)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n + i, " ".join([f"f{j}" for j in range(80)] + [f"own{i}{j}" for j in range(i % 25)])) for i in range(60)]
    for part in (60, 85):
        found = near_duplicates(make(rows), k=2, similarity=Similarity(part, 100), bits=18, cells=14)
        assert listed(found, "doc_id", "n_shingles", "component_id") == sorted(brute.components(rows, 2, part, 100), key=repr)


def test_near_duplicates_on_documents(small_documents):
    found = near_duplicates(small_documents, k=4, similarity=Similarity(85, 100), bits=20, cells=14)
    want = sorted(brute.components(pairs(small_documents), 4, 85, 100), key=repr)
    assert listed(found, "doc_id", "n_shingles", "component_id") == want


def test_boundary_follows_cost():
    s = Similarity(85, 100)
    assert boundary({}, s) == 0
    assert boundary({10: (1000, 1)}, s) == 0
    assert boundary({10: (1, 1000)}, s) >= 5


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in [*range(41), 200]} | {100: 100, 101: 100, 102: 100}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
