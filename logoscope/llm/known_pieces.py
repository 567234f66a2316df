"""Ids of byte strings that were met before, in hash tables of numpy arrays, which look up many at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes of the longest string that is a key of the arrays: with its length it makes two 64-bit numbers.
WIDTH = 15
#: Bytes of the longest string that is remembered, and how many short ones take the room of one beyond WIDTH.
KEPT_BYTES, ROOM = 64, 5
#: Strings remembered in each of two generations, some 60 bytes each: this bounds a worker's memory whatever the corpus.
REMEMBERED = 240_000
_SIZES = range(WIDTH + 2)
_LOW = np.array([2 ** (8 * min(s, 8)) - 1 for s in _SIZES[:-1]] + [0], np.uint64)
_HIGH = np.array([2 ** (8 * max(s - 8, 0)) - 1 for s in _SIZES[:-1]] + [0], np.uint64)
_TAG = np.array([s << 56 for s in _SIZES[:-1]] + [255 << 56], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each stretch of ``data``, equal where bytes and length are; stretches of more than WIDTH bytes have a
    pair that no other has. ``data`` ends with 16 bytes that belong to no stretch."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = np.minimum(size, WIDTH + 1)
    return words[begin] & _LOW.take(size), words[begin + 8] & _HIGH.take(size) | _TAG.take(size)


def spread(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches pool[at : at + n], one after the other."""
    shift = np.repeat(at - (np.cumsum(n) - n), n)
    shift += np.arange(len(shift))
    return pool.take(shift)


class Table:
    """One generation: an open-addressed table of keys and the place of their ids; longer strings in a dictionary."""

    def __init__(self, kind: np.dtype):
        self.lo, self.hi, self.at, self.n = (np.zeros(1 << 12, k) for k in (np.uint64, np.uint64, np.int32, np.uint8))
        self.size, self.used, self.ids = 0, 0, np.empty(1 << 13, kind)
        self.long: dict[bytes, tuple[int, int]] = {}

    def __len__(self) -> int:
        return self.size + len(self.long)

    def keys(self) -> set[bytes]:
        both = zip(self.lo[self.hi > 0].tolist(), self.hi[self.hi > 0].tolist(), strict=True)
        return {(a.to_bytes(8, "little") + b.to_bytes(8, "little"))[: b >> 56] for a, b in both} | self.long.keys()

    def _home(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = lo * _MIX[0] ^ hi * _MIX[1]
        h ^= h >> np.uint64(29)
        h *= _MIX[2]
        return (h >> np.uint64(64 - (len(self.hi).bit_length() - 1))).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't there."""
        found, live, slot = np.full(len(lo), -1), np.arange(len(lo)), self._home(lo, hi)
        while len(live):
            there = self.hi.take(slot)
            same = (there == hi) & (self.lo.take(slot) == lo)
            found[live[same]] = slot[same]
            on = np.flatnonzero(~same & (there != 0))
            live, lo, hi, slot = live[on], lo[on], hi[on], slot[on] + 1 & len(self.hi) - 1
        return found

    def keep(self, ids: np.ndarray) -> int:
        """Where ``ids`` begin, once they are added."""
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            more = np.empty(max(self.used, len(self.ids) * 3 // 2), self.ids.dtype)
            more[:start] = self.ids[:start]
            self.ids = more
        self.ids[start : self.used] = ids
        return start

    def add(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Adds different keys that aren't there."""
        self.size += len(lo)
        slots = len(self.hi)
        while self.size > slots * 5 // 8:
            slots *= 2
        if slots > len(self.hi):
            full = np.flatnonzero(self.hi)
            moved = [x[full] for x in (self.lo, self.hi, self.at, self.n)]
            self.lo, self.hi, self.at, self.n = (np.zeros(slots, x.dtype) for x in (self.lo, self.hi, self.at, self.n))
            self._put(*moved)
        self._put(lo, hi, at, n)

    def _put(self, lo, hi, at, n) -> None:
        slot = self._home(lo, hi)
        while len(slot):
            free = np.flatnonzero(self.hi.take(slot) == 0)
            spots, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.lo[spots], self.hi[spots], self.at[spots], self.n[spots] = lo[put], hi[put], at[put], n[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            lo, hi, at, n, slot = lo[rest], hi[rest], at[rest], n[rest], slot[rest] + 1 & len(self.hi) - 1


class Known:
    """Ids of strings in two generations, so that frequent strings outlive rare ones. ``ask`` gives the ids of many new
    ones, one after the other, and the number of each; a string has at most one id a byte."""

    def __init__(self, ask: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, limit: int = REMEMBERED):
        self.ask, self.kind, self.limit = ask, kind, limit
        self.new, self.old = Table(kind), Table(kind)

    def __len__(self) -> int:
        return len(self.new)

    def keys(self) -> set[bytes]:
        return self.new.keys()

    def look_up(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, at, n): the ids of each stretch of ``data`` (as ``keys`` takes them) are pool[at : at + n]."""
        if self.new.size + ROOM * len(self.new.long) >= self.limit:
            self.old, self.new = self.new, Table(self.kind)
        new, old = self.new, self.old
        lo, hi = keys(data, begin, size)
        slot = new.find(lo, hi)
        at, n = new.at.take(slot).astype(np.int64), new.n.take(slot).astype(np.int64)  # slots change as the table grows
        miss = np.flatnonzero(slot < 0)
        short, long = miss[size[miss] <= WIDTH], miss[size[miss] > WIDTH]
        order = short[np.lexsort((lo[short], hi[short]))]
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
        some = order[first]
        before = old.find(lo[some], hi[some])
        had, ask, before = some[before >= 0], some[before < 0], before[before >= 0]
        if len(had):
            counts = old.n[before].astype(np.int64)
            start = new.keep(spread(old.ids, old.at[before], counts))
            new.add(lo[had], hi[had], start + np.cumsum(counts) - counts, counts)

        strings = [data[b : b + s].tobytes() for b, s in zip(begin[long].tolist(), size[long].tolist(), strict=True)]
        asked = {}  # False: too long to stay
        for x in strings:
            if x not in new.long and x not in asked:
                if x in old.long:
                    b, s = old.long[x]
                    new.long[x] = (new.keep(old.ids[b : b + s]), s)
                else:
                    asked[x] = len(x) <= KEPT_BYTES
        ordered = sorted(asked, key=asked.get, reverse=True)
        stay = len(ask) + sum(asked.values())
        pieces = [data[b : b + s].tobytes() for b, s in zip(begin[ask].tolist(), size[ask].tolist(), strict=True)] + ordered
        extra, passing = new.ids[:0], {}
        if pieces:
            ids, counts = self.ask([p.decode() for p in pieces])
            kept = int(counts[:stay].sum())
            places = new.keep(ids[:kept]) + np.cumsum(counts) - counts
            extra = ids[kept:]
            new.add(lo[ask], hi[ask], places[: len(ask)], counts[: len(ask)])
            spots = list(zip(ordered, zip(places[len(ask) :].tolist(), counts[len(ask) :].tolist(), strict=True), strict=True))
            new.long.update(spots[: stay - len(ask)])
            passing = dict(spots[stay - len(ask) :])
        slot = new.find(lo[short], hi[short])
        at[short], n[short] = new.at.take(slot), new.n.take(slot)
        if strings:
            at[long], n[long] = np.array([new.long.get(x) or passing[x] for x in strings]).T
        return np.concatenate([new.ids[: new.used], extra]) if len(extra) else new.ids, at, n
