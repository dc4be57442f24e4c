"""Dual traversal of signature trees: links between the shingle sets of a block or of two.

A leaf holds a few sets; every node holds the OR of its sets' bitmaps, the range of their
sizes, and how many shingles at most share a bit of their set's bitmap with another one. Two
sets of a node pair can't have more in common than the bits in both bitmaps and that
excess. Pairs that can't reach the threshold are left out with all below them, and so are
pairs whose sets are known to hang together: one path is enough for components.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN, BITS = 16, 4, 2048
PIVOTS, CHUNK = 8, 1024


class Sets:
    """Shingle sets, one after the other: dense shingle numbers, where each set starts, sizes, bitmaps."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.size = sizes.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        known, self.shingle = np.unique(hashes, return_inverse=True)
        self.known = len(known)
        self.mark = np.zeros(self.known, dtype=bool)
        owner = np.repeat(np.arange(len(sizes)), self.size)
        bit = (hashes % np.uint64(BITS)).astype(np.int64)
        flags = np.zeros((len(sizes), BITS), dtype=bool) if len(sizes) <= 8192 else None
        if flags is not None:
            flags[owner, bit] = True
            self.bits = np.packbits(flags, axis=1).view(np.uint64)
        else:
            self.bits = np.concatenate([_pack(owner, bit, at, min(at + 8192, len(sizes))) for at in range(0, len(sizes), 8192)])
        self.excess = self.size - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """Shingles that set ``one`` has in common with each of the others."""
        own = self.shingle[self.first[one] : self.first[one] + self.size[one]]
        self.mark[own] = True
        length = self.size[others]
        place = np.cumsum(length) - length
        at = np.arange(int(length.sum())) - np.repeat(place, length) + np.repeat(self.first[others], length)
        found = np.add.reduceat(self.mark[self.shingle[at]], place, dtype=np.int64)
        self.mark[own] = False
        return found


def _pack(owner, bit, start, end):
    own = (owner >= start) & (owner < end)
    flags = np.zeros((end - start, BITS), dtype=bool)
    flags[owner[own] - start, bit[own]] = True
    return np.packbits(flags, axis=1).view(np.uint64)


class Tree:
    """Levels from leaves to root over sets in a given order."""

    def __init__(self, sets: Sets, order: np.ndarray, height: int | None = None):
        self.order = order
        edges = np.append(np.arange(0, len(order), LEAF), len(order))
        self.edges = edges
        cut = lambda f, v: f.reduceat(v, edges[:-1], axis=0)
        level = {"bits": cut(np.bitwise_or, sets.bits[order]), "least": cut(np.minimum, sets.size[order]), "most": cut(np.maximum, sets.size[order]), "excess": cut(np.maximum, sets.excess[order])}
        self.levels, self.child = [level], []
        while len(level["least"]) > 1 or (height is not None and len(self.levels) < height):
            at = np.arange(0, len(level["least"]), FAN)
            self.child.append(np.append(at, len(level["least"])))
            f = {"bits": np.bitwise_or, "least": np.minimum, "most": np.maximum, "excess": np.maximum}
            level = {k: f[k].reduceat(v, at, axis=0) for k, v in level.items()}
            self.levels.append(level)

    def labelled(self, label: np.ndarray) -> None:
        """Smallest and largest label below each node."""
        low = np.minimum.reduceat(label[self.order], self.edges[:-1])
        high = np.maximum.reduceat(label[self.order], self.edges[:-1])
        self.low, self.high = [low], [high]
        for edges in self.child:
            self.low.append(np.minimum.reduceat(self.low[-1], edges[:-1]))
            self.high.append(np.maximum.reduceat(self.high[-1], edges[:-1]))


def links(sets: Sets, percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that link (100 * common >= percent * united) and tie together all that links tie together.

    With ``split``, sets below it and sets from it on are two blocks whose own pairs are
    somebody else's; pairs within one may still turn up.
    """
    n = len(sets.size)
    label, found = np.arange(n), []

    def check(one: int, others: np.ndarray) -> bool:
        others = others[label[others] != label[one]]
        if not len(others):
            return False
        both = sets.common(one, others)
        others = others[both * (100 + percent) >= percent * (sets.size[one] + sets.size[others])]
        if not len(others):
            return False
        groups, first = np.unique(label[others], return_index=True)
        found.extend((one, int(o)) for o in others[first])
        joined = np.append(groups, label[one])
        label[np.isin(label, joined)] = joined.min()
        return True

    if n <= LEAF and split is None:
        for one in range(n - 1):
            check(one, np.arange(one + 1, n))
        return found
    left = np.arange(n)
    for _ in range(PIVOTS):  # most sets of a crowd link with one of these
        counts = np.bincount(label)
        left = np.flatnonzero(label != counts.argmax()) if counts.max() > 1 else left
        if len(left) < 2:
            break
        check(int(left[len(left) // 2]), np.arange(n))
    by = lambda own: own[np.lexsort((sets.shingle[sets.first[own]], sets.size[own], label[own]))]
    if split is None:
        trees = [Tree(sets, by(np.arange(n)))] * 2
    else:
        trees = [Tree(sets, by(np.arange(split))), Tree(sets, by(np.arange(split, n)))]
        height = max(len(t.levels) for t in trees)
        trees = [t if len(t.levels) == height else Tree(sets, t.order, height) for t in trees]
    one, two = trees

    def relabel():
        one.labelled(label)
        if two is not one:
            two.labelled(label)

    relabel()
    stack = [(len(one.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        if len(x) > CHUNK:
            stack.append((level, x[CHUNK:], y[CHUNK:]))
            x, y = x[:CHUNK], y[:CHUNK]
        apart = (one.low[level][x] != two.low[level][y]) | (one.high[level][x] != two.high[level][y]) | (one.low[level][x] != one.high[level][x])
        x, y = x[apart], y[apart]
        a, b = one.levels[level], two.levels[level]
        fits = (100 * a["most"][x] >= percent * b["least"][y]) & (100 * b["most"][y] >= percent * a["least"][x])
        x, y = x[fits], y[fits]
        both = np.bitwise_count(a["bits"][x] & b["bits"][y]).sum(axis=1, dtype=np.int64) + np.minimum(a["excess"][x], b["excess"][y])
        both = np.minimum(both, np.minimum(a["most"][x], b["most"][y]))
        fits = both * (100 + percent) >= percent * (a["least"][x] + b["least"][y])
        x, y = x[fits], y[fits]
        if not len(x):
            continue
        if level:
            ex, ey = one.child[level - 1], two.child[level - 1]
            nx, ny = ex[x + 1] - ex[x], ey[y + 1] - ey[y]
            pair = np.repeat(np.arange(len(x)), nx * ny)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
            x, y = ex[x][pair] + k // ny[pair], ey[y][pair] + k % ny[pair]
            if one is two:
                x, y = x[x <= y], y[x <= y]
            stack.append((level - 1, x, y))
            continue
        changed = False
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            own, others = one.order[one.edges[p] : one.edges[p + 1]], two.order[two.edges[q] : two.edges[q + 1]]
            both = np.bitwise_count(sets.bits[own][:, None] & sets.bits[others]).sum(axis=2, dtype=np.int64) + np.minimum(sets.excess[own][:, None], sets.excess[others])
            may = (both * (100 + percent) >= percent * (sets.size[own][:, None] + sets.size[others])) & (label[own][:, None] != label[others])
            for i in np.flatnonzero(may.any(axis=1)):
                right = others[may[i]]
                changed |= check(int(own[i]), right[right != own[i]])
        if changed:
            relabel()
    return found
