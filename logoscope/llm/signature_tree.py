"""Sets of word shingles as sorted hashes, and links among sets by a signature tree.

A node of the tree holds the OR of its sets' bitmaps, their range of sizes and the most members that share a bit of a
set. A dual traversal from (root, root) down drops a pair of nodes when no two of their sets can be similar enough: their
sizes differ too much, or the bits that both bitmaps have, and the members that bitmaps may hide, are too few.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(1971)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Children of a node, bits for each member of the largest set.
FAN_OUT, BITS_PER_MEMBER = 8, 8
#: Bytes of bitmaps, and members of sets, that one step of a comparison holds, however large the sets are.
STEP_BYTES, STEP_MEMBERS = 1 << 22, 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int):
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            table = np.full(max(n, 1 << 16), base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case; words are what ASCII white space separates."""
    raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes, this lowers A-Z alone
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(b) + 1)
    inside = np.concatenate([[False], ~_WHITE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-word shingle at each place; of fewer words the whole sequence as one; of none nothing."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        h = h + words[j : n - width + 1 + j] * _PLACE[j]
    return mixed(h)


def required(a, b, num: int, den: int):
    """Least overlap at which sets of sizes a and b have a Jaccard similarity of num / den."""
    return -(-num * (a + b) // (num + den))


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (np.concatenate(sets) >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)
    flags = np.zeros((len(sets), bits), bool)
    flags[rows, at] = True
    return np.packbits(flags, axis=1).view(np.uint64)


class Tree:
    """Levels of nodes over sets, from the leaves (single sets) to the root; a node's children are FAN_OUT neighbours."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        bits = 1 << max(6, int(BITS_PER_MEMBER * size.max() - 1).bit_length())
        step = max(1, STEP_BYTES // bits)
        maps = np.concatenate([_bitmaps(sets[i : i + step], bits) for i in range(0, len(sets), step)])
        hidden = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, hidden)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            cut = np.arange(0, len(low), FAN_OUT)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)
            ))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether sets of nodes a and b of a level can be similar."""
        maps, low, high, hidden = self.levels[level]
        near = (high[a] * den >= num * low[b]) & (high[b] * den >= num * low[a])
        i = np.flatnonzero(near)
        step = max(1, STEP_BYTES // (8 * maps.shape[1]))
        for start in range(0, len(i), step):
            part = i[start : start + step]
            x, y = a[part], b[part]
            most = np.bitwise_count(maps[x] & maps[y]).sum(1).astype(np.int64) + np.minimum(hidden[x], hidden[y])
            near[part] = most >= required(low[x], low[y], num, den)
        return near

    def joined(self, num: int, den: int, stop: int = 1):
        """Pairs (a, b), a <= b, of nodes of level ``stop`` that survive the dual traversal."""
        top = len(self.levels) - 1
        a = b = np.zeros(1, np.int64)
        for level in range(top - 1, min(stop, top) - 1, -1):
            n = len(self.levels[level][1])
            child = np.arange(FAN_OUT)
            x = (a[:, None, None] * FAN_OUT + child[:, None]).repeat(FAN_OUT, 2).ravel()
            y = (b[:, None, None] * FAN_OUT + child).repeat(FAN_OUT, 1).ravel()
            fine = (x <= y) & (y < n)
            x, y = x[fine], y[fine]
            fine = self.possible(level, x, y, num, den) | (x == y)
            a, b = x[fine], y[fine]
        return a, b


def forest(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None) -> np.ndarray:
    """For each of several non-empty sets the number of a set that stands for its component of links.

    ``labels`` are components known before. Sets of one component are not compared again: sets are taken as pivots, from
    the smallest component first, and compared with all sets of other components that the tree leaves, until all sets
    that were not pivots are in one component. No pair of different components stays unexamined."""
    m = len(sets)
    part = np.arange(m) if labels is None else np.unique(labels, return_inverse=True)[1]
    order = np.lexsort(([len(s) for s in sets], [s[0] for s in sets]))  # near sets mostly share their least member
    sets = [sets[i] for i in order]
    part = part[order]
    size = np.array([len(s) for s in sets])
    if m > 1:
        tree = Tree(sets)
        level = min(1, len(tree.levels) - 1)
        a, b = tree.joined(num, den, level)
        width = FAN_OUT**level
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        by = np.argsort(a, kind="stable")
        b = b[by]
        first = np.searchsorted(a[by], np.arange(-(-m // width) + 1))
    waiting = np.ones(m, bool)
    while m > 1:
        alive, count = np.unique(part[waiting], return_counts=True)
        if len(alive) < 2:
            break
        pivot = int(np.flatnonzero(waiting & (part == alive[count.argmin()]))[0])
        waiting[pivot] = False
        nodes = np.unique(b[first[pivot // width] : first[pivot // width + 1]])
        near = (nodes[:, None] * width + np.arange(width)).ravel()
        near = near[near < m]
        near = near[waiting[near] & (part[near] != part[pivot])]
        near = near[tree.possible(0, np.full(len(near), pivot), near, num, den)]
        step = min(256, max(1, STEP_MEMBERS // int(size[pivot])))  # what the tree leaves is about as large as the pivot
        for start in range(0, len(near), step):
            some = near[start : start + step]
            some = some[part[some] != part[pivot]]
            if not len(some):
                continue
            members = np.concatenate([sets[i] for i in some])
            at = np.minimum(np.searchsorted(sets[pivot], members), size[pivot] - 1)
            cut = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            overlap = np.add.reduceat((sets[pivot][at] == members).astype(np.int64), cut)
            linked = some[overlap >= required(size[some], size[pivot], num, den)]
            if len(linked):
                part[np.isin(part, part[linked])] = part[pivot]
    stand = np.zeros(m, np.int64)
    stand[order] = part
    _, at, back = np.unique(stand, return_index=True, return_inverse=True)
    return at[back]
