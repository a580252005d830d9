"""Conversation repair against exhaustive search, and its audits against plain strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from strayrows.llm import conversation_repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, live string, copies int, kind string"
WHITE = " \t\n\x0b\f\r"


def plain_damage(rows):
    """Rows after damage, by turn; equal turns by role and hash."""
    out = {}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        own = out.setdefault(c, [])
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(own, key=key) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)
        out.append("b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def moves(row, fault):
    """(cost, initial, role initial or None) of every edit of a row."""
    yield 2, "D", None
    if fault not in ("b", "d"):
        more = 5 if fault == "t" else 0
        if row[1]:
            yield more, "K", row[1]
        yield 1 + more, "R", "user"
        yield 1 + more, "R", "assistant"


def exhaustive(rows, marks):
    """All edits and insertions of a few rows: (cost, audit, repaired)."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*[list(moves(r, f)) for r, f in zip(rows, marks)]):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, kept = 0, "", []
            for i, new in enumerate(put):
                cost, audit = cost + 5 * len(new), audit + "I" * len(new)
                kept += [f"{x}:" for x in new]
                if i < len(rows):
                    c, letter, role = edits[i]
                    cost, audit = cost + c, audit + letter
                    kept += [] if role is None else [f"{role}:{rows[i][2]}"]
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in kept)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, kept
    return best


def stepwise(rows, marks):
    """The same for any number of rows: best (cost, audit, repaired) per shape of what is left."""
    shape = re.compile("(s?(ua)*u?)?")
    state = lambda k: "".join(x[0] for x in k)[-1:] if k else ""

    def insert(best):
        for _ in range(2):
            for cost, audit, kept in list(best.values()):
                for role in ("user:", "assistant:"):
                    put(best, cost + 5, audit + "I", [*kept, role])
        return best

    def put(best, cost, audit, kept):
        if shape.fullmatch("".join(x[0] for x in kept)):
            s = state(kept)
            if s not in best or (cost, audit) < best[s][:2]:
                best[s] = cost, audit, kept

    best = insert({"": (0, "", [])})
    for row, fault in zip(rows, marks):
        new = {}
        for cost, audit, kept in best.values():
            for c, letter, role in moves(row, fault):
                put(new, cost + c, audit + letter, kept if role is None else [*kept, f"{role}:{row[2]}"])
        best = insert(new)
    return min(best[s] for s in ("", "a") if s in best)


def answers(rows, solve=stepwise):
    out = {}
    for c, own in plain_damage(rows).items():
        marks = faults(own)
        cost, audit, kept = solve(own, marks)
        turns = [r[0] for r in own if r[0] is not None]
        first = [r[1][:1] for r in own]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            marks.count("b"), marks.count("d"), marks.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
            cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def found(spark, rows, **more):
    source = spark.createDataFrame([(*r, "x", "y", 3, "k") for r in rows], SCHEMA)
    hurt = R.damaged(source.repartition(3))
    audits = R.audits(hurt, **more).cache()
    digests = {r[0]: r[1] for r in R.digests(R.repaired(hurt, audits)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*tuple(r)[1:], digests.get(r.conv_id, empty)) for r in audits.collect()}


def made(seed, n, length):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(r.randint(1, length)):
            role = r.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "User"])
            text = r.choice(["Yes.", "No!", "Why", "ok", "", " \t", None, "Éa 中.\n", "Tell me?", f"{r.random()}."])
            rows.append((c, r.choice([i, i, i, i + 1, None]), role, text))
    return rows


def test_exhaustive(spark):
    rows = made(1, 60, 3)
    expected = {c: v for c, v in answers(rows, exhaustive).items()}
    assert answers(rows) == expected
    assert found(spark, rows) == expected


@pytest.mark.parametrize("piece", [1, 5, 1024])
def test_many(spark, piece):
    odd = [
        (None, 0, "user", "A null conversation."), (None, None, None, None), (-5, 1, "user", "x." * 50_000),
        (7777, 3, "user", None), (7778, None, None, None), (7779, 0, "system", "Only."),
    ]
    again = [(500, 4, "user", "Again.")] * 40 + [(500, i, "user", "Again.") for i in range(40)]
    rows = made(2, 150, 9) + made(3, 1, 400)[:300] + odd + again + [(600, i % 37, "assistant", "Hm.") for i in range(300)]
    assert found(spark, rows, piece=piece) == answers(rows)


def test_one_long_conversation_in_pieces(spark):
    r = random.Random(5)
    rows = [(1, i, r.choice(["user", "assistant", "assistant", "user", "tool"]), r.choice(["Well.", "x", "y?", f"z{i}."])) for i in range(3000)]
    assert found(spark, rows, piece=64) == answers(rows)


def test_no_rows(spark):
    assert found(spark, []) == {}
    assert R.repaired(R.damaged(spark.createDataFrame([], SCHEMA)), R.audits(spark.createDataFrame([], SCHEMA))).count() == 0


def test_repaired_rows_of_undamaged_conversations(spark):
    source = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (2, 0, "assistant", "Hello.")], "conv_id int, turn int, role string, text string")
    audits = R.audits(source)
    rows = sorted(tuple(r) for r in R.repaired(source, audits).collect())
    assert {r.conv_id: (r.cost, r.audit) for r in audits.collect()} == {1: (1, "KR"), 2: (2, "D")}
    assert rows == [(1, 0, "user", "Hi."), (1, 1, "assistant", "There.")]


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7])
def test_trail(modulus):
    r = random.Random(7)
    trail, nodes = R.Trail(modulus), {"": 0}
    for _ in range(3000):
        text = r.choice(list(nodes)[-20:]) + r.choice("DIKR")
        nodes[text] = trail.add(nodes[text[:-1]], text[-1])
    assert len(set(nodes.values())) == len(nodes)
    texts = list(nodes)
    for _ in range(3000):
        a, b = r.choice(texts), r.choice(texts)
        assert trail.less(nodes[a], nodes[b]) == (a < b)
        assert trail.add(nodes[a[:-1]], a[-1]) == nodes[a] if a else True
    assert all(trail.text(x) == t for t, x in nodes.items())


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    listed = [tuple(r) for r in rows.collect()]
    assert found(spark, listed) == answers(listed)
