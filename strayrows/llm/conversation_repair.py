"""Repair of conversation structure by a cheapest-edits program over persistent audits.

The rows of a conversation, by turn, pass an automaton of four states: nothing yet, after a system row, after
a user row, after an assistant row. Every row is kept, given another role or deleted, and empty rows may be
inserted; the conversation must end empty or after an assistant row. What is kept for a state is its cheapest
cost and the audit that reaches it, the initials of its edits (Keep, Rerole, Delete, Insert).

Audits are linked nodes that share their prefixes (`Trail`): a node knows its ancestors at powers of two and the
rolling hash of its text, under which it is found again; a hash that two texts share is
told apart by parent and letter. Equal texts are thus one node, and of two audits of equal cost the smaller one
follows from their longest common prefix, a search over ancestors.

Two audits that reach one state at one row with equal cost are never prefixes of each other, as the longer
one would hold one more insertion. So a cheapest, then smallest audit stays so whatever follows, and runs of rows
can be solved apart: a run of rows gives the best audit from each state to each state, and runs are joined in
order. That cuts a conversation of any length into bounded pieces, solved where the global order puts them.

Rows are compared by the SHA-256 of their texts; only `repaired` moves texts. Rows of one turn come by role, then by
that hash. A null role or text is one space, a null turn comes first, a null conv_id is a conversation of its own. A
role whose first character is not s, u or a (or that is empty) can't be kept. Repeated rows are duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrows.llm.carried import output_type
from strayrows.llm.registry import query, table
from strayrows.staging import stage

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
LEGAL = {"su", "ua", "au"}
#: Where the initial of an emitted row leads; a user row after a user row, or an assistant row elsewhere,
#: needs the insertion that comes between.
STEPS = {
    "s": [(EMPTY, SYSTEM, 0)],
    "u": [(EMPTY, USER, 0), (SYSTEM, USER, 0), (ASSISTANT, USER, 0), (USER, USER, 1)],
    "a": [(USER, ASSISTANT, 0), (EMPTY, ASSISTANT, 1), (SYSTEM, ASSISTANT, 1), (ASSISTANT, ASSISTANT, 1)],
}
#: Insertions that end a conversation well.
CLOSING = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


class Trail:
    """Texts as linked nodes: node 0 is empty, every other one is its parent and a letter."""

    _MODULUS, _BASE = (1 << 61) - 1, 911382323

    def __init__(self, modulus: int = _MODULUS):
        self.modulus = modulus
        self.letter, self.depth, self.hash, self.up = [""], [0], [1], [[0]]
        self.by_hash: dict[int, list[int]] = {}

    def add(self, node: int, letter: str) -> int:
        """The node of the text of `node` and `letter`."""
        h = (self.hash[node] * self._BASE + ord(letter)) % self.modulus
        known = self.by_hash.setdefault(h, [])
        for x in known:  # the hash alone proves nothing
            if self.up[x][0] == node and self.letter[x] == letter:
                return x
        new, above = len(self.letter), [node]
        while above[-1] and len(self.up[above[-1]]) >= len(above) and self.up[above[-1]][len(above) - 1]:
            above.append(self.up[above[-1]][len(above) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(h)
        self.up.append(above)
        known.append(new)
        return new

    def at_depth(self, node: int, depth: int) -> int:
        left = self.depth[node] - depth
        while left:
            k = min(left.bit_length(), len(self.up[node])) - 1
            node, left = self.up[node][k], left - (1 << k)
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the text of x comes before that of y."""
        if x == y:
            return False
        shorter = min(self.depth[x], self.depth[y])
        a, b = self.at_depth(x, shorter), self.at_depth(y, shorter)
        if a == b:
            return self.depth[x] < self.depth[y]
        k = len(self.up[a]) - 1
        while k >= 0:  # to the children of the longest common prefix
            if k < len(self.up[a]) and k < len(self.up[b]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
            else:
                k -= 1
        return self.letter[a] < self.letter[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def edits(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of every edit of a row that may belong to a cheapest audit.

    An insertion before a deleted row is left out: after it, it costs as much and sorts earlier.
    """
    out = [(x, x, DELETE, "D") for x in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT_OFF else 0
    for emitted, steps in STEPS.items():
        if emitted == initial:
            cost, letter = KEEP, "K"
        elif emitted != "s":
            cost, letter = REROLE, "R"
        else:
            continue
        out += [(a, b, cost + more + n * INSERT, "I" * n + letter) for a, b, n in steps]
    return out


EDITS = {(i, f): edits(i, f) for i in ("s", "u", "a", "") for f in range(4)}


class Piece:
    """A run of rows of one conversation: what joining it with its neighbours needs."""

    def __init__(self, conv, starts: tuple[int, ...]):
        self.conv, self.rows = conv, 0
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.first = self.last = None
        self.turns, self.low, self.high = 0, None, None
        self.trail = Trail()
        self.best: dict[int, dict[int, tuple[int, int]]] = {s: {s: (0, 0)} for s in starts}

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.rows += 1
        self.faults[fault] += 1
        if self.rows == 1:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        trail = self.trail
        for start, now in self.best.items():
            new: dict[int, tuple[int, int]] = {}
            for a, b, cost, letters in EDITS[initial if initial in "sua" else "", fault]:
                if a in now:
                    total = now[a][0] + cost
                    if b in new and total > new[b][0]:
                        continue
                    node = now[a][1]
                    for letter in letters:
                        node = trail.add(node, letter)
                    if b not in new or total < new[b][0] or trail.less(node, new[b][1]):
                        new[b] = (total, node)
            self.best[start] = new

    def row(self, part: int, number: int) -> tuple:
        cells = [self.best.get(a, {}).get(b) for a in range(4) for b in range(4)]
        return (
            self.conv, part, number, self.rows, *self.faults[1:], self.illegal, self.first, self.last,
            self.turns, self.low, self.high, [x and x[0] for x in cells], [x and self.trail.text(x[1]) for x in cells],
        )


PIECE = (
    "part int, number bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first string, last string, turns bigint, low bigint, high bigint, costs array<bigint>, audits array<string>"
)
AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` bytes, by `size` of a row."""
    held, total = [], 0

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        total += size(r)
        if total > most:
            yield packed()
            held, total = [], 0
    if held:
        yield packed()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _same(a, b) -> bool:
    return a == b and (a is None) == (b is None)


def prepared(source: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, live, copies); the last two are true and 1 unless `source` has them as `_live`, `_copies`."""
    has = lambda c, x: F.col(c) if c in source.columns else F.lit(x)
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return source.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        filled(role).alias("role"),
        filled(text).alias("text"),
        has("_live", True).alias("live"),
        has("_copies", 1).cast("bigint").alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """(conv, live, turn, role, sha, copy, initial, fault) of every row, without its text.

    Equal rows are counted before anything is joined, so neither they nor a text that fills a conversation
    meet in one task.
    """
    live = F.col("live")
    only = lambda x: F.when(live, x)
    counted = (
        rows.select(
            "conv", "live", only(F.col("turn")).alias("turn"), only(F.col("role")).alias("role"), "copies",
            only(F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("sha"),
            only(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            only(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"),
        )
        .groupBy("conv", "live", "turn", "role", "sha")
        .agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("cut_off").alias("cut_off"))
    )
    counted = stage(counted, "rows")
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = (
        counted.where("live")
        .groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"))
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places"))
        .where("places > 1")
    )
    met = F.col("c").eqNullSafe(F.col("conv")) & (F.col("r") == F.col("role")) & (F.col("s") == F.col("sha"))
    block = 1 << 16
    copies = (
        counted.join(first, met, "left")
        .withColumn("again", F.coalesce(place > F.col("first"), F.lit(False)))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.when(live, ((F.col("n") - 1) / block).cast("int")).otherwise(0))))
        .withColumn("copy", F.explode(F.sequence(F.col("block") * block + 1, F.least(F.when(live, F.col("n")).otherwise(1), (F.col("block") + 1) * F.lit(block).cast("bigint")))))
    )
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("again") | (F.col("copy") > 1), DUPLICATE)
        .when(F.col("cut_off"), CUT_OFF)
        .otherwise(FINE)
    )
    return copies.select("conv", "live", "turn", "role", "sha", "copy", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _pieces(schema: pa.Schema, most: int):
    """Cuts a range of the global order into pieces of at most `most` rows."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, number, piece = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for conv, live, turn, initial, fault in zip(*[c.to_pylist() for c in batch.columns]):
                new = piece is not None and not _same(piece.conv, conv)
                if piece is None or new or piece.rows >= most:
                    if piece is not None:
                        yield piece.row(part, number)
                        number += 1
                    # A conversation that starts within the range starts from nothing; else its earlier rows decide.
                    piece = Piece(conv, (EMPTY,) if new else (EMPTY, SYSTEM, USER, ASSISTANT))
                if live:
                    piece.add(turn, initial, fault)
        if piece is not None:
            yield piece.row(part, number)

    return lambda batches: _batches(pieces(batches), schema, lambda r: 200 + sum(len(x or "") for x in r[-1]))


class Rope:
    """An audit as the audits of its pieces, linked backwards; prefixes are shared."""

    __slots__ = ("before", "piece")

    def __init__(self, before: Rope | None, piece: str):
        self.before, self.piece = before, piece

    def text(self, until: Rope | None = None) -> str:
        out, x = [], self
        while x is not until:
            out.append(x.piece)
            x = x.before
        return "".join(reversed(out))

    def less(self, other: Rope) -> bool:
        """Both have as many pieces; what they share is not compared."""
        a, b = self, other
        while a is not b:
            a, b = a.before, b.before
        return self.text(a) < other.text(a)


def _joined(schema: pa.Schema):
    """Pieces of a conversation, in order, to its audit."""

    def closed(conv, best, counts, low, high, turns) -> tuple:
        ends = [(cost + CLOSING[s] * INSERT, rope.text() + "I" * CLOSING[s]) for s, (cost, rope) in best.items()]
        cost, audit = min(ends)
        return conv, (high - low + 1 - turns if turns else 0), *counts, cost, audit

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for (conv, _, _, n, blank, duplicate, truncated, illegal, first, last, turns, low, high, costs, texts) in zip(
                *[c.to_pylist() for c in batch.columns]
            ):
                if held is None or not _same(held[0], conv):
                    if held is not None:
                        yield closed(held[0], *held[1:6])
                    held = [conv, {EMPTY: (0, Rope(None, ""))}, [0, 0, 0, 0], None, None, 0, None]
                _, best, counts, *_ = held
                for k, x in enumerate((blank, duplicate, truncated, illegal)):
                    counts[k] += x
                if not n:
                    continue
                if held[6] is not None and held[6] + first not in LEGAL:
                    counts[3] += 1
                held[6] = last
                if turns:
                    held[5] += turns - (held[4] == low)
                    held[3] = low if held[3] is None else held[3]
                    held[4] = high
                new: dict[int, tuple[int, Rope]] = {}
                for a, (cost, rope) in best.items():
                    for b in range(4):
                        more, text = costs[4 * a + b], texts[4 * a + b]
                        if more is None or b in new and cost + more > new[b][0]:
                            continue
                        x = Rope(rope, text)
                        if b not in new or cost + more < new[b][0] or x.less(new[b][1]):
                            new[b] = (cost + more, x)
                held[1] = new
        if held is not None:
            yield closed(held[0], *held[1:6])

    return lambda batches: _batches(audits(batches), schema, lambda r: 100 + len(r[-1]))


def audits(
    source: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = 1024
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation.

    Conversations are solved in pieces of at most `piece` rows; what a task holds is bounded by a piece, and
    where pieces are joined by the audit itself. No rows: no conversations.
    """
    rows = prepared(source, conv, turn, role, text)
    keys = ["conv", "live", "turn", "role", "sha", "copy"]
    piece_type, audit_type = output_type(rows, ["conv"], PIECE), output_type(rows, ["conv"], AUDIT)
    ranged = _marked(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = ranged.select("conv", "live", "turn", "initial", "fault").mapInArrow(_pieces(_arrow(piece_type), piece), piece_type)
    joined = (
        pieces.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(_joined(_arrow(audit_type)), audit_type)
    )
    return joined.withColumnRenamed("conv", "conv_id")


def _rows(schema: pa.Schema):
    """Rows of a conversation after its audit, in order, to its repaired rows."""

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, audit, at, state, place = None, "", 0, EMPTY, 0

        def inserted():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = ASSISTANT if state == USER else USER
                yield conv, place, "assistant" if state == ASSISTANT else "user", ""
                at, place = at + 1, place + 1

        for batch in batches:
            for c, kind, role, copies, text, given in zip(*[x.to_pylist() for x in batch.columns]):
                if kind == 0:
                    yield from inserted()
                    conv, audit, at, state, place = c, given, 0, EMPTY, 0
                    continue
                for _ in range(copies):
                    yield from inserted()
                    edit, at = audit[at], at + 1
                    if edit == "D":
                        continue
                    if edit == "K":
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                        yield conv, place, role, text
                    else:
                        state = ASSISTANT if state == USER else USER
                        yield conv, place, "assistant" if state == ASSISTANT else "user", text
                    place += 1
        yield from inserted()

    return lambda batches: _batches(repaired(batches), schema, lambda r: 100 + len(r[3]))


def repaired(
    source: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, place, role, text): the rows that the audits `found` leave, one conversation in one partition, in order.

    A task streams its rows; it holds one audit and one batch.
    """
    rows = prepared(source, conv, turn, role, text)
    out = output_type(rows, ["conv"], "place bigint, role string, text string")
    both = rows.where("live").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
        "copies", "text", F.lit(None).cast("string").alias("audit"),
    ).unionByName(
        found.select(F.col("conv_id").alias("conv"), F.lit(0).alias("kind"), "audit"), allowMissingColumns=True
    )
    ordered = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "sha")
    return (
        ordered.select("conv", "kind", "role", "copies", "text", "audit").mapInArrow(_rows(_arrow(out)), out).withColumnRenamed("conv", "conv_id")
    )


def _digested(schema: pa.Schema):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import hashlib

        conv, digest = None, None
        for batch in batches:
            for c, place, role, text in zip(*[x.to_pylist() for x in batch.columns]):
                if place == 0:
                    if digest is not None:
                        yield conv, digest.hexdigest()
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield conv, digest.hexdigest()

    return lambda batches: _batches(digests(batches), schema, lambda r: 100)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as `repaired` orders them: a digest is sequential by its nature, so it is
    taken row by row where the rows of a conversation pass."""
    out = output_type(rows, ["conv_id"], "repaired_sha256 string")
    return rows.mapInArrow(_digested(_arrow(out)), out)


def damaged(source: DataFrame) -> DataFrame:
    """`source` (conv_id, turn, role, text) with the faults that a hash of conversation and turn chooses.

    `_live` is false for dropped rows, `_copies` is 2 for repeated ones.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text: Column = (
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    )
    return source.select(
        "conv_id", "turn", filled("role").alias("r"), filled("text").alias("t"), fault.alias("fault")
    ).select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("r")).alias("role"),
        text.alias("text"),
        (F.col("fault") != 0).alias("_live"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("_copies"),
    )


def _way(a: str, cost: str, letters: str, rows: str, when: str) -> str:
    return (
        f"CASE WHEN ({when}) AND s.{a}.c IS NOT NULL THEN {{'c': s.{a}.c + {cost}, 't': s.{a}.t || '{letters}', "
        f"'r': s.{a}.r || {rows}}} END"
    )


def _moves() -> str:
    """Of each state after a row: cheapest cost, smallest audit, repaired rows."""
    own, to_user, to_assistant = "[role || ':' || text]", "['user:' || text]", "['assistant:' || text]"
    more = "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    out = {"e": [], "s": [], "u": [], "a": []}
    for x in out:
        out[x].append(_way(x, "2", "D", "[]::VARCHAR[]", "true"))
    free = "fault NOT IN (1, 2)"
    out["s"].append(_way("e", more, "K", own, f"{free} AND initial = 's'"))
    for x, n in (("e", 0), ("s", 0), ("a", 0), ("u", 1)):
        ins, cost = (["", "['assistant:'] || "][n]), 5 * n
        out["u"].append(_way(x, f"{cost} + {more}", "I" * n + "K", ins + own, f"{free} AND initial = 'u'"))
        out["u"].append(_way(x, f"{cost} + 1 + {more}", "I" * n + "R", ins + to_user, f"{free} AND initial <> 'u'"))
    for x, n in (("u", 0), ("e", 1), ("s", 1), ("a", 1)):
        ins, cost = (["", "['user:'] || "][n]), 5 * n
        out["a"].append(_way(x, f"{cost} + {more}", "I" * n + "K", ins + own, f"{free} AND initial = 'a'"))
        out["a"].append(_way(x, f"{cost} + 1 + {more}", "I" * n + "R", ins + to_assistant, f"{free} AND initial <> 'a'"))
    return "{" + ", ".join(f"'{to}': list_min(list_filter([{', '.join(w)}], lambda x: x.c IS NOT NULL))" for to, w in out.items()) + "}"


_NONE = "{'c': NULL::BIGINT, 't': NULL::VARCHAR, 'r': NULL::VARCHAR[]}"
_CRC = (
    "xor(list_reduce(string_split(key, ''), lambda c, b: list_reduce(range(8), "
    "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, ord(b)::BIGINT)), 4294967295::BIGINT), 4294967295)"
)
SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), hit AS (SELECT *, {_CRC} % 20 AS f FROM keyed),
faulty AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE r END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE f <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS before
  FROM faulty
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 1)::BIGINT AS blank, count(*) FILTER (fault = 2)::BIGINT AS duplicate,
         count(*) FILTER (fault = 3)::BIGINT AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n
  FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'e': {{'c': 0::BIGINT, 't': '', 'r': []::VARCHAR[]}}, 's': {_NONE}, 'u': {_NONE}, 'a': {_NONE}}} AS s
  FROM facts
  UNION ALL
  SELECT w.conv_id, w.i + 1, {_moves()} FROM walk AS w JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
), ended AS (
  SELECT f.*, list_min(list_filter([s.e, {{'c': s.s.c + 10, 't': s.s.t || 'II', 'r': s.s.r || ['user:', 'assistant:']}},
           {{'c': s.u.c + 5, 't': s.u.t || 'I', 'r': s.u.r || ['assistant:']}}, s.a], lambda x: x.c IS NOT NULL)) AS b
  FROM facts AS f JOIN walk AS w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.t, '') AS audit, sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    found = stage(audits(rows), "audits")
    taken = digests(repaired(rows, found)).withColumnRenamed("conv_id", "c")
    return found.join(taken, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        *found.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    )
