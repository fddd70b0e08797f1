"""Signature trees over sets: nodes hold the OR of their members' token bitmaps and the range of their sizes.

The bitmaps have one bit for each token that two sets or more of the comparison share, so the number of bits that two nodes
have in common bounds the overlap of any pair below them. A dual traversal drops node pairs whose sizes are too
different or whose bound is below the overlap that the threshold asks for, and node pairs whose members are all joined
already; what is left is counted exactly. Memory follows the number of tokens: leaves hold few tokens or a single set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Most sets and, unless it has but one, most tokens of a leaf; bytes of leaf matrices that are kept.
LEAF, LEAF_TOKENS, KEPT = 32, 1 << 14, 1 << 24
#: Bits of the hashed bitmap that stands for a whole block.
BLOCK_BITS = 1 << 13


class Links:
    """Union-find over positions; the smallest position is the root. Positions with one label are joined from the start."""

    def __init__(self, n: int, labels: Sequence[int] | None = None):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)] if labels is not None else list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((a, b))


class SignatureTree:
    """A binary tree over sets in the order given; node k has children 2k+1 and 2k+2 or is a leaf."""

    def __init__(self, columns: list[np.ndarray], sizes: np.ndarray, n_tokens: int):
        self.columns, self.sizes, self.n_tokens = columns, sizes, n_tokens
        self.tokens = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
        self.spans: dict[int, tuple[int, int]] = {}
        self.bits: dict[int, np.ndarray] = {}
        self.range: dict[int, tuple[int, int]] = {}
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0
        if columns:
            self._build(0, 0, len(columns))

    def _build(self, node: int, a: int, b: int) -> np.ndarray:
        self.spans[node] = a, b
        self.range[node] = int(self.sizes[a:b].min()), int(self.sizes[a:b].max())
        if self.is_leaf(node):
            own = np.zeros(self.n_tokens, dtype=bool)
            for c in self.columns[a:b]:
                own[c] = True
            self.bits[node] = np.packbits(own)
        else:
            middle = (a + b) // 2
            self.bits[node] = self._build(2 * node + 1, a, middle) | self._build(2 * node + 2, middle, b)
        return self.bits[node]

    def is_leaf(self, node: int) -> bool:
        a, b = self.spans[node]
        return b - a == 1 or (b - a <= LEAF and self.tokens[b] - self.tokens[a] <= LEAF_TOKENS)

    def matrix(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a leaf in order, and which of them each member has."""
        if node not in self.kept:
            a, b = self.spans[node]
            own = self.columns[a:b]
            tokens, place = np.unique(np.concatenate(own), return_inverse=True)
            out = np.zeros((b - a, len(tokens)), dtype=np.float32)
            out[np.repeat(np.arange(b - a), [len(c) for c in own]), place.reshape(-1)] = 1
            if self.held + out.nbytes > KEPT:
                self.kept.clear()
                self.held = 0
            self.kept[node] = tokens, out
            self.held += out.nbytes
        return self.kept[node]


def may_link(sizes: tuple[int, int], others: tuple[int, int], overlap: int, percent: int) -> bool:
    """Whether sets of sizes in two ranges that have at most so many tokens in common can reach the threshold."""
    (low_a, high_a), (low_b, high_b) = sizes, others
    if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
        return False
    return (100 + percent) * overlap >= percent * (low_a + low_b)


def overlaps(x: SignatureTree, a: int, y: SignatureTree, b: int) -> np.ndarray:
    """Tokens in common of each member of one leaf with each of another."""
    (ours, left), (theirs, right) = x.matrix(a), y.matrix(b)
    if not len(theirs):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    at = np.minimum(np.searchsorted(theirs, ours), len(theirs) - 1)
    both = np.flatnonzero(theirs[at] == ours)
    return np.rint(left[:, both] @ right[:, at[both]].T).astype(np.int64)


def traverse(x: SignatureTree, y: SignatureTree, offset: int, links: Links, percent: int) -> None:
    """Join all linked pairs of x and y, which may be one tree; positions of y start at ``offset``."""
    same, todo = x is y, [(0, 0)] if x.spans and y.spans else []
    while todo:
        a, b = todo.pop()
        if not may_link(x.range[a], y.range[b], int(np.bitwise_count(x.bits[a] & y.bits[b]).sum()), percent):
            continue
        if x.is_leaf(a) and y.is_leaf(b):
            (a0, a1), (b0, b1) = x.spans[a], y.spans[b]
            roots = {links.find(i) for i in range(a0, a1)} | {links.find(i + offset) for i in range(b0, b1)}
            if len(roots) == 1:
                continue
            both = overlaps(x, a, y, b)
            total = x.sizes[a0:a1, None] + y.sizes[None, b0:b1]
            for i, j in np.argwhere((both > 0) & ((100 + percent) * both >= percent * total)).tolist():
                if not (same and a0 + i >= b0 + j):
                    links.join(a0 + i, b0 + j + offset)
        elif same and a == b:
            todo += [(2 * a + 1, 2 * a + 1), (2 * a + 2, 2 * a + 2), (2 * a + 1, 2 * a + 2)]
        elif y.is_leaf(b) or (not x.is_leaf(a) and x.spans[a][1] - x.spans[a][0] >= y.spans[b][1] - y.spans[b][0]):
            todo += [(2 * a + 1, b), (2 * a + 2, b)]
        else:
            todo += [(a, 2 * b + 1), (a, 2 * b + 2)]


def linked(first: list[np.ndarray], second: list[np.ndarray] | None, percent: int, labels: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within ``first``, or between ``first`` and ``second`` (whose positions follow on).

    Sets are two rows of 64 bits, distinct columns in order. Two sets link when 100 * |both| >= percent * |either| and
    neither is empty. Sets with the same label count as joined already.
    """
    sets = first + (second or [])
    sizes = np.array([s.shape[1] for s in sets], dtype=np.int64)
    grams = np.concatenate(sets, axis=1) if sets else np.zeros((2, 0), np.uint64)
    order = np.lexsort((grams[1], grams[0]))
    ranked = grams[:, order]
    fresh = np.concatenate([[True], (ranked[:, 1:] != ranked[:, :-1]).any(axis=0)])[: len(order)]
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number) > 1 if len(order) else np.zeros(0, dtype=bool)
    column, token = np.cumsum(shared) - 1, np.empty(len(order), dtype=np.int64)
    token[order] = np.where(shared[number], column[number], -1) if len(order) else number
    columns = [own[own >= 0] for own in np.split(token, np.cumsum(sizes)[:-1])] if sets else []

    def tree(positions: range) -> tuple[SignatureTree, list[int]]:
        near = sorted(positions, key=lambda i: (sizes[i], columns[i][:4].tolist()))
        return SignatureTree([columns[i] for i in near], sizes[near] if near else sizes[:0], int(shared.sum())), near

    x, own = tree(range(len(first)))
    if second is None:
        places, y, offset = own, x, 0
    else:
        y, others = tree(range(len(first), len(sets)))
        places, offset = own + others, len(own)
    links = Links(len(places), None if labels is None else [labels[i] for i in places])
    traverse(x, y, offset, links, percent)
    return [(places[a], places[b]) for a, b in links.edges]


def block_signature(sets: list[np.ndarray]) -> tuple[int, int, int, bytes]:
    """Smallest and largest size, most tokens of a set that its bitmap doesn't show, and the OR of the hashed bitmaps."""
    whole, hidden = np.zeros(BLOCK_BITS, dtype=bool), 0
    for own in sets:
        bits = np.unique(own[0] & np.uint64(BLOCK_BITS - 1))
        hidden = max(hidden, own.shape[1] - len(bits))
        whole[bits] = True
    sizes = [s.shape[1] for s in sets]
    return min(sizes), max(sizes), hidden, np.packbits(whole).tobytes()
