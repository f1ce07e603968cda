"""Small numpy building blocks shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Open-addressing map of non-negative int64 keys to int32 values with vectorised lookups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        n = max(16, 1 << int(2 * max(1, len(keys)) - 1).bit_length())
        self._shift = np.uint64(64 - n.bit_length() + 1)
        self._mask = n - 1
        self._keys = np.full(n, -1, np.int64)
        self._values = np.full(n, -1, np.int32)
        pending = np.arange(len(keys))
        at = self._slot(keys)
        while len(pending):
            slots = at[pending]
            free = self._keys[slots] < 0
            _, first = np.unique(slots, return_index=True)
            chosen = np.zeros(len(pending), bool)
            chosen[first] = True
            chosen &= free
            put = pending[chosen]
            self._keys[at[put]] = keys[put]
            self._values[at[put]] = values[put]
            pending = pending[~chosen]
            at[pending] = (at[pending] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where a key is absent."""
        at = self._slot(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._values[at], np.int32(-1)).astype(np.int64)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            found = self._keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Recent:
    """Values of texts seen lately: about ``most`` bytes in two generations, of which the older one is
    forgotten when the newer one has half of them."""

    def __init__(self, most: int) -> None:
        self._most, self._size = most, 0
        self.now: dict = {}
        self._before: dict = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys whose values have to be put; all others are in ``now`` until the next call."""
        if 2 * self._size > self._most:
            self._before, self.now, self._size = self.now, {}, 0
        out = []
        for k in keys:
            if k not in self.now:
                value = self._before.get(k)
                if value is None:
                    out.append(k)
                else:
                    self.put(k, value)
        return out

    def put(self, key: str, value: object) -> None:
        self.now[key] = value
        self._size += 200 + 6 * len(key)


class WordHashes(dict):
    """word -> 64-bit xxHash as int64, remembered for up to ``most`` words."""

    def __init__(self, most: int = 1_000_000) -> None:
        super().__init__()
        self._most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self._most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode())
        h -= (h >> 63) << 64
        self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
