import os

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that operators use themselves.
    "n_words bigint, kept_text string, doc bigint, key bigint, node string, word string"
)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), 7, "kept", 1, 2, "node", "w")


def passage(seed, n):
    return " ".join(f"w{(seed * 7919 + i * 31) % 997}x{(seed + i) % 13}" for i in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names clash."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    long = passage(1, 6000)
    shared = passage(2, 60)
    base = passage(3, 120)
    lines = "\n".join(passage(10 + i, 14) for i in range(6))
    return [
        (5, None), (6, ""), (7, " \t\n\x0b "), (8, "one"), (9, "One"), (10, "one two three"), (11, "one  two\tthree"),
        (12, long), (13, long + " tail"), (14, f"{passage(4, 40)} {shared} {passage(5, 30)}"),
        (15, f"{shared}\n{passage(6, 50)}"), (16, f"{passage(7, 20)} {shared}"),
        (20, base), (21, base), (22, base.replace(" ", "  ")), (23, base + " extra"), (24, base.upper()),
        (30, lines), (31, lines.replace("x3", "y3", 1)), (32, f"{lines}\n{passage(30, 12)}"), (32, f"{lines}\n{passage(30, 12)}"),
        (33, f"{passage(30, 12)} more\n\nen.\nen."), (34, "naïve café 中文 " * 30), (35, "le le le le " * 40),
        (36, "中" * 3000), (None, base), (None, passage(50, 30)), (40, "a b   c"), (40, passage(51, 25)),
    ]


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows)


@pytest.fixture(scope="session")
def small_documents(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no example tables")
    return spark.read.parquet(f"{SMALL}/documents.parquet")
