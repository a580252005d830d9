"""Sums of distances in the plane without meeting all pairs.

Places are halved into boxes, the leaves of a tree. Seen from APART half sides away, a distance to a box is so smooth that
ORDER x ORDER nodes in it stand for its places: their weights are spread over the nodes (`spread`), and sums at the
nodes of the other box are read off at its own places. Boxes nearer than that are divided, and places of near leaves meet one by
one. What this leaves out is below the rounding of a sum of doubles (some 1e-14 of it); no place is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Nodes of a box by side, the distance in half sides from which they stand for its places, and places of a leaf.
ORDER, APART, LEAF = 16, 2.0, 512
#: Rows of a matrix of distances that stay in a core's cache.
ROWS = 96

_AT = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_TURN = np.cos(np.outer(np.arange(ORDER), np.arccos(_AT))) * np.where(np.arange(ORDER) > 0, 2.0, 1.0)[:, None] / ORDER


@dataclass
class Box:
    """A node of a tree: its corners, its places as a slice of the ordered ones, its halves (none in a leaf)."""

    lo: tuple[float, float]
    hi: tuple[float, float]
    first: int = 0
    last: int = 0
    halves: tuple[int, int] | None = None

    @property
    def half(self) -> float:
        return max(self.hi[0] - self.lo[0], self.hi[1] - self.lo[1]) / 2

    @property
    def centre(self) -> tuple[float, float]:
        return (self.lo[0] + self.hi[0]) / 2, (self.lo[1] + self.hi[1]) / 2

    @property
    def sides(self) -> tuple[float, float]:
        """Half the sides, as seen from the rounded centre."""
        x, y = self.centre
        return max(self.hi[0] - x, x - self.lo[0]), max(self.hi[1] - y, y - self.lo[1])

    def nodes(self, origin: tuple[float, float]) -> np.ndarray:
        """Places of the nodes from `origin`, so that boxes far from 0 lose no digits."""
        x, y = (c - o + half * _AT for c, o, half in zip(self.centre, origin, self.sides))
        return np.stack([np.repeat(x, ORDER), np.tile(y, ORDER)], axis=1)


def tree(places: np.ndarray) -> tuple[np.ndarray, list[Box]]:
    """The order of different places [n, 2] along the leaves, and all boxes, halves after their whole.

    It depends on the set of places only.
    """
    order = np.lexsort((places[:, 1], places[:, 0]))
    boxes, at = [_box(places, order, 0, len(order))], 0
    while at < len(boxes):
        box = boxes[at]
        if box.last - box.first > LEAF:
            own = order[box.first : box.last]
            axis = int(box.hi[1] - box.lo[1] > box.hi[0] - box.lo[0])
            middle = len(own) // 2
            order[box.first : box.last] = own[np.argpartition(places[own, axis], middle)]
            box.halves = (len(boxes), len(boxes) + 1)
            boxes.append(_box(places, order, box.first, box.first + middle))
            boxes.append(_box(places, order, box.first + middle, box.last))
        at += 1
    return order, boxes


def _box(places: np.ndarray, order: np.ndarray, first: int, last: int) -> Box:
    return box(places[order[first:last]], first)


def box(own: np.ndarray, first: int = 0) -> Box:
    """The box of some places, the first of them at `first`."""
    return Box(tuple(own.min(axis=0).tolist()), tuple(own.max(axis=0).tolist()), first, first + len(own))


def spread(places: np.ndarray, box: Box) -> np.ndarray:
    """[place, node]: how much of a smooth function's value at a place, given from the centre, comes from each node of the box."""
    sides = []
    for i, half in enumerate(box.sides):
        t = np.clip(places[:, i] / half, -1.0, 1.0) if half > 0 else np.zeros(len(places))
        sides.append(np.cos(np.outer(np.arccos(t), np.arange(ORDER))) @ _TURN)
    return (sides[0][:, :, None] * sides[1][:, None, :]).reshape(len(places), -1)


def moments(places: np.ndarray, weights: np.ndarray, boxes: Sequence[Box]) -> list[np.ndarray]:
    """Weights [node, cluster] of every box of a tree; places are in the tree's order."""
    out: list[np.ndarray] = [None] * len(boxes)
    for i in range(len(boxes) - 1, -1, -1):
        box = boxes[i]
        if box.halves is None:
            out[i] = spread(places[box.first : box.last] - box.centre, box).T @ weights[box.first : box.last]
        else:
            out[i] = sum(spread(boxes[h].nodes(box.centre), box).T @ out[h] for h in box.halves)
    return out


def away(lo: Sequence[float], hi: Sequence[float], box: Box) -> float:
    """The least distance between two boxes."""
    x = max(lo[0] - box.hi[0], box.lo[0] - hi[0], 0.0)
    y = max(lo[1] - box.hi[1], box.lo[1] - hi[1], 0.0)
    return (x * x + y * y) ** 0.5


def add(total: np.ndarray, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> None:
    """total[i] += distances of a[i] to all b, times their weights."""
    for i in range(0, len(a), ROWS):
        p = slice(i, i + ROWS)
        squares = a[p, 0, None] - b[:, 0]
        squares *= squares
        other = a[p, 1, None] - b[:, 1]
        other *= other
        squares += other
        total[p] += np.sqrt(squares, out=squares) @ weights


@dataclass
class Source:
    """What a box sends: weights at its nodes, the places themselves where they may be near, its halves."""

    box: Box
    moments: np.ndarray | None = None
    places: np.ndarray | None = None
    weights: np.ndarray | None = None
    halves: tuple[int, int] | None = None

    def at_nodes(self) -> np.ndarray:
        if self.moments is None:
            self.moments = spread(self.places - self.box.centre, self.box).T @ self.weights
        return self.moments


def sums(places: np.ndarray, weights: np.ndarray, boxes: Sequence[Box], others: Sequence[Source]) -> np.ndarray:
    """[place, cluster]: distances to all places of the tree and of the other sources, by weight; places are in the tree's order."""
    width, own = weights.shape[1], moments(places, weights, boxes)
    sources = [
        Source(b, m, *((None, None) if b.halves else (places[b.first : b.last], weights[b.first : b.last])), b.halves)
        for b, m in zip(boxes, own)
    ]
    sources += others
    total, local = np.zeros((len(places), width)), [None] * len(boxes)

    def meet(a: int, source: Source, to_nodes: bool, from_nodes: bool) -> None:
        box = boxes[a]
        if to_nodes and local[a] is None:
            local[a] = np.zeros((ORDER * ORDER, width))
        origin = box.centre if to_nodes else source.box.centre if from_nodes else (0.0, 0.0)
        into = local[a] if to_nodes else total[box.first : box.last]
        x = box.nodes(origin) if to_nodes else places[box.first : box.last] - origin
        y = source.box.nodes(origin) if from_nodes else source.places - origin
        add(into, x, y, source.at_nodes() if from_nodes else source.weights)

    pairs = [(0, s) for s in (0, *range(len(boxes), len(sources)))]
    while pairs:
        a, s = pairs.pop()
        box, source = boxes[a], sources[s]
        gap, ha, hb = away(box.lo, box.hi, source.box), box.half, source.box.half
        far_a, far_b = gap >= APART * ha, gap >= APART * hb
        if far_a and far_b:
            meet(a, source, True, True)
        elif box.halves and (ha >= hb or not source.halves):
            pairs += [(h, s) for h in box.halves]
        elif source.halves:
            pairs += [(a, h) for h in source.halves]
        else:
            n = ORDER * ORDER
            meet(a, source, far_a and box.last - box.first > n, source.places is None or far_b and len(source.places) > n)
    for a, box in enumerate(boxes):
        if local[a] is None:
            continue
        if box.halves is None:
            total[box.first : box.last] += spread(places[box.first : box.last] - box.centre, box) @ local[a]
        for h in box.halves or ():
            passed = spread(boxes[h].nodes(box.centre), box) @ local[a]
            local[h] = passed if local[h] is None else local[h] + passed
    return total
