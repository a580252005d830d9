"""Tokens, archives and packing: against the tokenizers library, round trips, all partitions."""

import base64
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strayrows.llm import bpe, warc
from strayrows.llm.packing import boundaries, pack

FILE = public_tokenizers.path("word_bpe_49k.json")


def same_as_library(rows, got):
    library = Tokenizer.from_file(FILE)
    library.no_truncation()
    library.no_padding()
    assert len(rows) == len(got)
    for text, found in zip(rows, got):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found[0], "<u4").tolist() == ids
        assert found[1] == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_texts(make):
    texts = [
        None, "", "  \n", "Hello, World's BEST 123 test!", "<|startoftext|>a <|endoftext|>b<|endoftext|>", "a b c\u0085d",
        "é ́x ﬁ ΑΣ Σ", "中文" * 900, "x" * 5000, "a1b2" * 800, "emoji 👩‍👩‍👧 🇩🇪", "can't we'll ' ll", "\x1c\x1dz\x1f q",
        "the same words again and again " * 300, "the same words again and again " * 300,
    ]
    df = make([(i, t) for i, t in enumerate(texts)])
    for mask, memo in ((7, 0), (511, 0), (7, 1000), (511, 9)):
        got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.encode(df, FILE, mask=mask, memo=memo).collect()}
        same_as_library(texts, [got[i] for i in range(len(texts))])
    assert bpe.encode(make([]), FILE).count() == 0


def test_bpe_of_documents(small_documents):
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.encode(small_documents, FILE, mask=63).collect()}
    texts = {r.doc_id: r.text for r in small_documents.collect()}
    same_as_library([texts[i] for i in sorted(texts)], [got[i] for i in sorted(texts)])


def test_chunks_are_cut_by_content():
    common = bytes(np.random.default_rng(0).integers(97, 123, 4000, dtype=np.uint8))
    a, b = bpe.chunked([b"first " + common, b"another beginning " + common], 63)
    parts = [{t[x:y] for x, y in spans} for t, spans in ((b"first " + common, a), (b"another beginning " + common, b))]
    assert len(parts[0] & parts[1]) >= 0.9 * len(parts[0])


def test_word_memo(monkeypatch):
    spec = Tokenizer.from_file(FILE).to_str()
    plain, rng = bpe.Encoder(spec), np.random.default_rng(2)
    texts = [" ".join(f"w{i}'s é{i % 7}" for i in rng.integers(0, 300, 200)).encode() for _ in range(8)] + [b"", b" \n", "中文 x".encode()]
    expected = [x.tobytes() for x in plain.plain(texts)]
    for most in (1, 100, 100_000):
        encoder = bpe.Encoder(spec, memo=most)
        for _ in range(2):
            assert encoder.encode(texts, 511) == expected
            assert [x.tobytes() for x in encoder.many(texts[:3])] == expected[:3]
    odd = [b"a\x01b \x01 plain words", b"x \x01\x01 y", b"a, b, c. d; e!", "é \x01".encode()]
    assert bpe.Encoder(spec, memo=1000).encode(odd, 511) == [x.tobytes() for x in plain.plain(odd)]
    encoder = bpe.Encoder(spec, memo=420)
    for i in range(9):  # frequent words stay, single ones go
        once = [b" ".join(b"s%dx%d" % (i, j) for j in range(150)) + b" often used words"]
        assert encoder.encode(once, 511) == [x.tobytes() for x in plain.plain(once)]
        assert len(encoder.memo.names) <= 420
    assert encoder.memo.rows[4].max() > 1
    monkeypatch.setattr(bpe.Words, "hashes", lambda self: (self.ends - self.starts).astype(np.uint64))
    assert bpe.Encoder(spec, memo=1000).encode(texts, 511) == expected


def test_bpe_of_repeated_identifiers(odd, make):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(7, "naïve café 中文 " * 200), (7, "plain words only " * 200), (7, "naïve café 中文 " * 200), (None, "中文 é " * 300), (None, "plain words only " * 200)]
    found = bpe.encode(make(rows), FILE, mask=31).collect()
    library = Tokenizer.from_file(FILE)
    expected = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in rows]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in found), key=repr) == sorted(expected, key=repr)


def test_joins_agree_wherever_a_text_is_cut():
    spec = Tokenizer.from_file(FILE).to_str()
    plain = bpe.Encoder(spec)
    texts = [
        "can't stop ' ll we'll <|endoftext|> é\u0301 x\u0301 ΑΣ Σ a\u0085b\u00a0c\n\nd 中文 中文 123 45a !!! ... x", "word", "a b", "x" * 300 + " y",
        " lead and trail  ", "one two three four five six seven eight nine ten", "e\u0301 " * 30,
    ]
    for text in map(str.encode, texts):
        whole = plain.plain([text])[0]
        for at in range(1, len(text)):
            if text[at] & 0xC0 != 0x80:
                left, right = plain.plain([text[:at], text[at:]])
                assert np.array_equal(plain.joined(text[:at], left, text[at:], right), whole)
                assert np.array_equal(plain.joined(text[:at], left, text[at:], right, words=1), whole)


def test_a_window_grows_until_both_sides_agree():
    """A tokenizer whose tokens reach over white space: pairs of words, counted from the start of what it is given."""
    spec = Tokenizer.from_file(FILE).to_str()
    encoder = bpe.Encoder(spec)

    def paired(texts):
        out = []
        for t in texts:
            w = t.split()
            out.append(np.array([hash(tuple(w[i : i + 2])) % 2**31 for i in range(0, len(w), 2)], "<u4"))
        return out

    encoder.plain = paired
    text = b" ".join(b"w%d" % i for i in range(41))
    for at in (30, 31, 32, 33, 60):
        left, right = paired([text[:at], text[at:]])
        assert np.array_equal(encoder.joined(text[:at], left, text[at:], right), paired([text])[0])


def test_table_of_shared_chunks(make):
    text = " ".join(f"word{i} and more" for i in range(400))
    rows = [(i, f"{i} {text} {i * 7}") for i in range(6)] + [(9, text), (9, text + " é" * 99), (10, None)]
    spec = Tokenizer.from_file(FILE).to_str()
    source = make(rows).select("doc_id", "text")
    shared = bpe.shared_chunks(source, spec, 63)
    encoder = bpe.Encoder(spec)
    assert len(shared) > 50 and all(any(c in (t or "").encode() for _, t in rows) for c in shared)
    assert all(np.array_equal(np.frombuffer(v, "<u4"), encoder.plain([c])[0]) for c, v in shared.items())
    few = bpe.shared_chunks(source, spec, 63, table_bytes=4000)
    assert 0 < len(few) < len(shared) and sum(map(len, few)) <= 4000
    for table in (shared, few, {}):
        encoder.shared = table
        texts = [(t or "").encode() for _, t in rows]
        assert encoder.encode(texts, 63) == [x.tobytes() for x in encoder.plain(texts)]


def written(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, same string, first bigint")
    path = str(tmp_path / "archive")
    warc.write(pages, path, **options)
    return path, sorted((tuple(r) for r in warc.read(spark, path).collect()), key=repr)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    mark = warc.MARK
    html = {
        1: "<p>x</p>", 2: None, 3: "", 4: "<p>x</p>", 5: mark, 6: f"a{mark}{mark}b\r\n\r\n{mark}", 7: "é中\n" * 700, 8: "é中\n" * 700,
        9: "z" * 5000, 10: "WARC/1.1\r", 11: "\r\n\r\n",
    }
    rows = [(i, f"http://h/{i} ?q=ü\r\n" if i % 2 else None, t, "s", 1) for i, t in html.items()] + [(9, "u", "z" * 5000, "s", 1)]
    rows.append((None, "u", "<p>x</p>", "s", 1))
    _, got = written(spark, tmp_path, rows, chunk_bytes=64)
    first = {2: None, 3: 2, 4: 1, 8: 7}
    want = [(i, len((t or "").encode()), digest(t), "revisit" if first.get(i) else "response", first.get(i)) for i, t in html.items()]
    want += [(9, 5000, digest("z" * 5000), "response", None), (None, 8, digest("<p>x</p>"), "revisit", 1)]
    assert got == sorted(want, key=repr)


def test_warc_keeps_short_payloads_as_responses(spark, tmp_path):
    _, got = written(spark, tmp_path, [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)], least=3)
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_warc_of_no_pages_and_a_damaged_one(spark, tmp_path):
    _, got = written(spark, tmp_path, [])
    assert got == []
    row = {"page_id": 1, "url": "u", "payload_bytes": 3, "payload_digest": digest("abc"), "refers_to": None}
    value = next(iter(warc.record(row, b"abc", "0-1", 64, "d"))).encode().removeprefix(warc.MARK.encode())
    assert warc.parse(value)["digest"] == digest("abc")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(value.replace(b"abc\r\n\r", b"abd\r\n\r"))
    with pytest.raises(ValueError, match="bytes"):
        warc.parse(value[:-4])


def test_chunks_of_payloads():
    for payload in (b"", b"abc", "é中".encode() * 50, (warc.MARK * 5).encode(), b"x" * 100):
        parts = list(warc.cut(payload, 16))
        assert b"".join(parts) == payload and all(len(p) <= 16 for p in parts)
        for p in parts:
            p.decode()
            assert warc.MARK.encode() not in p


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.unique(rng.integers(0, 40, 7))
        counts = rng.integers(1, 9, len(lengths))
        for k in (1, 2, 3, 9):
            found, padding = boundaries(lengths, counts, k)
            cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths.tolist(), counts.tolist()))
            tried = [
                cost((*some, int(lengths[-1])))
                for size in range(min(k, len(lengths)))
                for some in itertools.combinations(lengths[:-1].tolist(), size)
            ]
            assert padding == min(tried) == cost(found) and len(found) <= k
    assert boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == ([], 0)


def test_packing(odd, odd_rows, make):
    found = pack(odd, sequence=100, buckets=3, budget=400).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault((r.doc_id), []).append(r.n_tokens)
        assert r.n_tokens <= r.bucket_length <= 100
    want = {}
    for i, t in odd_rows:
        n = len((t or "").encode().split())
        want.setdefault(i, []).extend([100] * ((n - 1) // 100 if n else 0) + [n - 100 * ((n - 1) // 100) if n else 0])
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    batches = {}
    for r in found:
        batches.setdefault((r.bucket, r.bucket_length), {}).setdefault(r.batch, []).append((r.slot, r.doc_id, r.piece))
    for (_, length), own in batches.items():
        rows = max(400 // max(length, 1), 1)
        assert sorted(own) == list(range(len(own)))
        assert all(len(own[b]) == rows for b in list(own) if b < len(own) - 1)
        assert all(sorted(x[0] for x in members) == list(range(len(members))) for members in own.values())
        order = [(x[1] is not None, x[1] or 0, x[2]) for b in sorted(own) for x in sorted(own[b])]
        assert order == sorted(order)
    lengths, counts = np.unique([r.n_tokens for r in found], return_counts=True)
    assert sum(r.bucket_length - r.n_tokens for r in found) == boundaries(lengths, counts, 3)[1]
    assert pack(make([])).count() == 0
