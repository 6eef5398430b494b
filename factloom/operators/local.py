"""Solvers of one task: fixpoints over sorted arrays of packed pairs, for the units that ``units`` hands out.

Nodes are numbers from 0 to n - 1. A pair (x, y) is x * n + y, so that a sorted array of pairs is an index by x. Facts and edges
grow by what is new alone; products of a join are made and reduced in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from factloom.operators import units

#: Rows of a join that are made at once.
PIECE = 2_000_000

Pairs = tuple[np.ndarray, np.ndarray]


def _joined(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[Pairs]:
    """Places (i, j) with i in ``x`` and j from first[i] to last[i], in pieces."""
    n = last - first
    ends = np.cumsum(n)
    at = 0
    while at < len(x):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        some = n[at:to]
        i = np.repeat(np.arange(at, to), some)
        yield i, np.arange(len(i)) - np.repeat(ends[at:to] - some - done, some) + first[i]
        at = to


class Index:
    """Rows found by their key: (key, *columns) sorted by the key."""

    def __init__(self, key: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.key, self.columns = key[order], [c[order] for c in columns]

    def join(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """i, and the columns of each row whose key is x[i]."""
        if len(self.key):
            for i, j in _joined(x, np.searchsorted(self.key, x), np.searchsorted(self.key, x, "right")):
                yield i, *(c[j] for c in self.columns)


def _unique(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def _added(have: np.ndarray, found: np.ndarray) -> Pairs:
    """What of ``found`` isn't in ``have``, and both together; all are sorted and without repeats."""
    at = np.searchsorted(have, found)
    new = np.ones(len(found), bool)
    inside = at < len(have)
    new[inside] = have[at[inside]] != found[inside]
    return found[new], np.insert(have, at[new], found[new])


def inclusion(
    n: int, addr: Pairs, copies: Pairs, load: Pairs, store: Pairs, reads: Index | None = None,
    moves: Index | None = None, moved: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, calls: tuple[Index, Index] | None = None,
) -> Pairs:
    """Facts (v, o) of the inclusion-based solution of (dst, src) constraints: ``pointsto.inclusion`` in one task.

    ``reads`` has the cells that a load from an object reads. ``moves`` (v, to, offset) are pointers that are moved, by ``moved`` of objects and
    offsets. ``calls``: (operand, pos, node) by operand, and (site * positions + pos, node) by both, pos counted from 0 for what returns.
    """
    load_from, store_to = Index(load[1], load[0]), Index(store[0], store[1])
    pts = np.unique(addr[0] * n + addr[1])
    edges = np.unique((copies[1] * n + copies[0])[copies[0] != copies[1]])  # by source
    new = pts

    def over(have: np.ndarray, x: np.ndarray) -> Iterator[Pairs]:
        """i, and y of each pair (x[i], y) of ``have``."""
        for i, j in _joined(x, np.searchsorted(have, x * n), np.searchsorted(have, (x + 1) * n)):
            yield i, have[j] % n

    def linked(links: list[np.ndarray], src: np.ndarray, dst: np.ndarray) -> None:
        links.append(np.unique((src * n + dst)[src != dst]))

    while len(new):
        v, o = np.divmod(new, n)
        links, sent = [], []
        for i, dst in load_from.join(v):
            if reads is None:
                linked(links, o[i], dst)
            else:
                for k, cell in reads.join(o[i]):
                    linked(links, cell, dst[k])
        for i, src in store_to.join(v):
            linked(links, src, o[i])
        if calls is not None:
            given, formals = calls
            positions = 1 + max(c.max() if len(c) else 0 for c in (given.columns[0],))
            for i, pos, passed in given.join(v):
                for k, node in formals.join(o[i] * positions + pos):
                    back = pos[k] == 0
                    linked(links, np.where(back, node, passed[k]), np.where(back, passed[k], node))
        fresh, every = _added(edges, _unique(links))
        for i, dst in over(edges, v):
            sent.append(np.unique(dst * n + o[i]))
        for i, held in over(pts, fresh // n):
            sent.append(np.unique(fresh[i] % n * n + held))
        if moves is not None:
            for i, to, offset in moves.join(v):
                sent.append(np.unique(to * n + moved(o[i], offset)))
        edges = every
        new, pts = _added(pts, _unique(sent))
    return np.divmod(pts, n)


def unification(n: int, x: np.ndarray, y: np.ndarray, up: np.ndarray) -> np.ndarray:
    """For each of n terms the smallest of its class: links (x, y) join classes, and so do the pointees (``up``, -1 for none) of a class."""
    label = units.roots(n, x, y)
    below = np.flatnonzero(up >= 0)
    over = up[below]
    while True:
        # of each class the smallest label that its members' pointees have
        least = np.full(n, n)
        np.minimum.at(least, label[below], label[over])
        a, b = label[over], least[label[below]]
        apart = a != b
        if not apart.any():
            return label
        label = units.roots(n, a[apart], b[apart])[label]


class Graph:
    """Edges as one array sorted by where they begin, for searches from many nodes; ``blind`` are nodes that may lead anywhere."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, blind: np.ndarray) -> None:
        self.nodes, where = np.unique(np.r_[src, dst, blind], return_inverse=True)
        src, dst = where[: len(src)], where[len(src) : len(src) + len(dst)]
        order = np.argsort(src, kind="stable")
        self.to, self.first = dst[order].astype(np.int32), np.searchsorted(src[order], np.arange(len(self.nodes) + 1))
        self.blind = np.zeros(len(self.nodes), bool)
        self.blind[where[len(where) - len(blind) :]] = True

    def at(self, names: np.ndarray) -> np.ndarray:
        """The places of nodes, -1 for what no edge has."""
        if not len(self.nodes):
            return np.full(len(names), -1)
        i = np.minimum(np.searchsorted(self.nodes, names), len(self.nodes) - 1)
        return np.where(self.nodes[i] == names, i, -1)

    def waves(self, source: int, via: np.ndarray) -> Iterator[np.ndarray]:
        """The nodes that ``source`` reaches in 1, 2, .. edges and no fewer. Sets ``via``, which holds -1, to the smallest node one edge before."""
        last = np.array([source])
        while len(last):
            n = self.first[last + 1] - self.first[last]
            i = np.repeat(np.arange(len(last)), n)
            found = self.to[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[last], n)]
            new = via[found] < 0
            found, before = found[new], last[i[new]]
            via[found[::-1]] = before[::-1]  # ``last`` is sorted, so the smallest comes last
            last = np.unique(found)
            yield last
