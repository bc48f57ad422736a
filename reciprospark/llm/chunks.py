"""A bounded table of token ids by chunk of text, looked up for all chunks of a slice at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from . import bytewords as bw

#: Places of a table, of which at most half are taken; a full table starts anew. Some 27 MB.
PLACES = 1 << 21
#: Ids that a table holds before it starts anew: 16 MB.
MOST_IDS = 1 << 22
#: Longer chunks (bytes) are encoded whenever they are met: they seldom repeat, and a hash of 64 bits is trusted for short ones only. A chunk has no more ids than bytes.
LONG = 64


class ChunkTable:
    """``learn(data, starts, ends)`` yields (numbers of chunks, their ids one after another, number of ids of each) until every chunk was in one.

    Memory is bounded by PLACES and MOST_IDS, but for what one slice needs.
    """

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], places: int = PLACES):
        self.learn = learn
        self._clear(places)

    def _clear(self, places: int) -> None:
        self.places, self.taken, self.used = places, 0, 0
        self.shift = np.uint64(64 - places.bit_length() + 1)
        self.key = np.zeros(places, np.uint64)
        self.at, self.n = np.zeros(places, np.int32), np.zeros(places, np.uint8)
        self.pool = np.zeros(1 << 16, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        place = (keys >> self.shift).astype(np.int64)
        there = self.key[place]
        found = np.where(there == keys, place, -1)
        todo = np.flatnonzero((found < 0) & (there != 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & (self.places - 1)
            there = self.key[place[todo]]
            same = there == keys[todo]
            found[todo[same]] = place[todo[same]]
            todo = todo[~same & (there != 0)]
        return found

    def _learnt(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray]:
        """The places in the pool and numbers of ids of chunks, put behind what is there; without ``keep`` the next call overwrites them."""
        at, n, end = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.used
        for which, ids, size in self.learn(data, starts, ends):
            if end + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), end + len(ids) - len(self.pool)), np.int32)])
            self.pool[end : end + len(ids)] = ids
            at[which], n[which] = end + np.cumsum(size) - size, size
            end += len(ids)
        if keep:
            self.used = end
        return at, n

    def _insert(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        place, todo = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[place[todo]] == 0]
            self.key[place[free]] = keys[free]  # of several for one place the last stays
            todo = todo[self.key[place[todo]] != keys[todo]]
            place[todo] = (place[todo] + 1) & (self.places - 1)
        self.at[place], self.n[place] = at, n
        self.taken += len(keys)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, number of ids of each chunk). Chunks are ascending spans of UTF-8; those marked ``alone`` aren't kept."""
        at, n = self.found(data, starts, ends, alone)
        return self.pool[places_of(at, n)], n

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first id's place in the pool, number of ids) of each chunk, until the next call."""
        keys = bw.span_hashes(data, starts, ends)
        keys[keys == 0] = 1
        direct = ends - starts > LONG if alone is None else (ends - starts > LONG) | alone
        place = self._place(keys)
        new = np.flatnonzero((place < 0) & ~direct)
        if len(new):
            unique, first = np.unique(keys[new], return_index=True)
            if self.taken and (2 * (self.taken + len(unique)) > self.places or self.used > MOST_IDS):
                self._clear(PLACES)
                return self.found(data, starts, ends, alone)
            if 2 * len(unique) > self.places:  # of a single long text
                self._clear(1 << int(2 * len(unique)).bit_length())
            self._insert(unique, *self._learnt(data, starts[new[first]], ends[new[first]], keep=True))
            place = self._place(keys)
        at, n = self.at[place].astype(np.int64), self.n[place].astype(np.int64)
        if direct.any():
            own = np.flatnonzero(direct)
            at[own], n[own] = self._learnt(data, starts[own], ends[own], keep=False)
        return at, n


def places_of(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The whole numbers ``at`` to ``at + n - 1`` of each pair, one run after another."""
    total = np.cumsum(n)
    return np.repeat(at - total + n, n) + np.arange(total[-1] if len(n) else 0)


def per_text(n: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Sums of ``n`` over the chunks of each text. ``texts`` holds where each text starts, and one place more."""
    total = np.concatenate([[0], np.cumsum(n)])
    return np.diff(total[np.searchsorted(starts, texts)])
