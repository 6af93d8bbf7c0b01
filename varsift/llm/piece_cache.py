"""A cache from pieces (byte strings) to their token ids that is looked up for many pieces at once.

Pieces of up to fifteen bytes, which nearly all are, pack into two words together with their length, so equal words are
equal pieces. They stand in an open-addressing table of numpy arrays that all pieces of a batch probe together; longer
ones are in a dict. Ids lie one after the other in a pool, from which results are gathered. When the table is full it
starts anew, so memory stays bounded; a text of more pieces than the table holds is looked up in parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pieces that a worker keeps, and pieces that are looked up at once.
MOST_PIECES, PART = 1 << 19, 1 << 17
SHORT = 15

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class PieceCache:
    """resolve: the ids of each of a list of distinct pieces, as one array, and how many each has."""

    def __init__(self, resolve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST_PIECES):
        self.resolve, self.most = resolve, most
        self.slots = 1 << (2 * most - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.entry = np.full(self.slots, -1, np.int32)
        self.low, self.high = np.empty(self.most, np.uint64), np.empty(self.most, np.uint64)
        self.start, self.size = np.empty(self.most, np.int64), np.empty(self.most, np.int32)
        self.count = self.used = 0
        self.pool = np.empty(4 * self.most, np.uint32)
        self.long: dict[bytes, int] = {}

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) & np.uint64(self.slots - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for none."""
        out = np.full(len(low), -1, np.int32)
        slot, left = self._slot(low, high), np.arange(len(low))
        while len(left):
            e = self.entry[slot]
            at = np.maximum(e, 0)
            hit = (self.low[at] == low) & (self.high[at] == high) & (e >= 0)
            out[left[hit]] = e[hit]
            on = (e >= 0) & ~hit
            left, slot, low, high = left[on], (slot[on] + 1) & (self.slots - 1), low[on], high[on]
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        slot = self._slot(low, high)
        while len(entries):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entries[free]
            on = self.entry[slot] != entries
            slot, entries = (slot[on] + 1) & (self.slots - 1), entries[on]

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Entries for distinct new pieces."""
        ids, sizes = self.resolve(pieces)
        entries = np.arange(self.count, self.count + len(pieces))
        self.size[entries] = sizes
        self.start[entries] = self.used + np.cumsum(sizes) - sizes
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.count, self.used = self.count + len(pieces), self.used + len(ids)
        return entries

    def _entries(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        low = words[starts] & _MASKS[np.minimum(n, 8)]
        high = (words[starts + 8] & _MASKS[np.clip(n - 8, 0, 7)]) | (n.astype(np.uint64) << np.uint64(56))
        short = n <= SHORT
        out = np.full(len(n), -1, np.int32)
        out[short] = self._find(low[short], high[short])
        long = np.flatnonzero(~short).tolist()
        named = [buffer[starts[i] : ends[i]] for i in long]
        out[long] = [self.long.get(p, -1) for p in named]
        missing = np.flatnonzero((out < 0) & short)
        order = missing[np.lexsort((high[missing], low[missing]))]
        first = np.ones(len(order), bool)
        first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        fresh = order[first]
        fresh_long = list(dict.fromkeys(p for p in named if p not in self.long))
        if self.count + len(fresh) + len(fresh_long) > self.most:
            self._clear()
            return self._entries(buffer, starts, ends)
        if len(fresh) or fresh_long:
            entries = self._add([buffer[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist())] + fresh_long)
            self.low[entries[: len(fresh)]], self.high[entries[: len(fresh)]] = low[fresh], high[fresh]
            self._insert(low[fresh], high[fresh], entries[: len(fresh)].astype(np.int32))
            self.long.update(zip(fresh_long, entries[len(fresh) :].tolist()))
            out[order] = entries[np.cumsum(first) - 1]
            out[long] = [self.long[p] for p in named]
        return out

    def look_up(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of each piece's."""
        buffer += b"\0" * 16
        part = min(PART, self.most)
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int32)]
        for a in range(0, len(starts), part):
            entries = self._entries(buffer, starts[a : a + part], ends[a : a + part])
            sizes.append(self.size[entries])
            ids.append(self.pool[runs(self.start[entries], sizes[-1])])
        return np.concatenate(ids), np.concatenate(sizes)
