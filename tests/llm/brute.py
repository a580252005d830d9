"""Plain versions of the operators, all pairs and all windows in memory."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LAST = (1 << 63) - 1
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return (text or "").encode().split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def exact(rows):
    """rows (doc_id, text) -> sorted answers of exact dedup."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, sha(norm(t).encode())))
    return sorted(out, key=repr)


def substring(rows, length):
    """rows (doc_id, text) -> (doc_id, n_words, kept words) per row."""
    owner = {}
    order = lambda i: LAST if i is None else i
    runs = [(order(i), words(t)) for i, t in rows]
    for i, w in runs:
        for j in range(len(w) - length + 1):
            x = tuple(w[j : j + length])
            owner[x] = min(owner.get(x, i), i)
    out = []
    for (i, _), (o, w) in zip(rows, runs):
        gone = set()
        for j in range(len(w) - length + 1):
            if owner[tuple(w[j : j + length])] < o:
                gone |= set(range(j, j + length))
        out.append((i, len(w), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lines(rows, least, near):
    """rows (doc_id, text) -> (doc_id, n_removed, kept text); equal rows count once."""
    order = {(LAST if i is None else i, t or "") for i, t in rows}
    seen, gone = [], defaultdict(set)
    for i, t in sorted(order):  # texts that share a doc_id share no line in the tests
        for n, line in enumerate(t.encode().split(b"\n")):
            w = line.split()
            if len(w) < least:
                continue
            for _, other in seen:
                if w == other or min(len(w), len(other)) >= near and one_edit(w, other):
                    gone[i, t].add(n)
                    break
            seen.append(((i, n), w))
    out = []
    for i, t in rows:
        own = gone[LAST if i is None else i, t or ""]
        parts = (t or "").encode().split(b"\n")
        out.append((i, len(own), b"\n".join(p for n, p in enumerate(parts) if n not in own).decode()))
    return out


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))) if w else frozenset()


def components(rows, k, part, whole):
    """rows (doc_id, text) -> (doc_id, n, component) per row."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in lists[x]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if whole * n >= part * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def quality_counts(text):
    w = words(text)
    t = text or ""
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = defaultdict(int)
    for x in windows:
        often[x] += 1
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(covered)
