"""Words of many texts at once: places, 64-bit hashes and a compact table of what is known about them.

For operators that look every word of every text up. Bytes are split at ASCII
white space; hashes mix eight bytes at a time. Two of n words share a hash with
a probability of about n * n / 2 ** 65: one in ten million for a table of two
million words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

U = np.uint64
_M1, _M2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def split(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts; start and end of each word in it; words per text."""
    buffer = b"\n".join(texts)
    a = np.frombuffer(buffer, np.uint8)
    if not len(a):
        return buffer, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate(([0] if not space[0] else [], edge, [len(a)] if not space[-1] else [])).astype(np.int64)
    start, end = edge[0::2], edge[1::2]
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(start, stops)
    return buffer, start, end, np.diff(upto, prepend=0)


def hashes(buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = buffer + b"\0" * 8
    eight = np.ndarray((len(buffer) + 1,), "<u8", padded, 0, (1,))
    length = end - start
    h = length.astype(np.uint64) * _M1
    todo, k = np.arange(len(start)), 0
    while len(todo):
        part = eight[start[todo] + k] & _MASK[np.minimum(length[todo] - k, 8)]
        x = (h[todo] ^ part) * _M1
        x ^= x >> U(32)
        x *= _M2
        x ^= x >> U(29)
        h[todo] = x
        k += 8
        todo = todo[length[todo] > k]
    return h


class Table:
    """Hash to slot, as sorted runs that are merged as they grow."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 for unknown keys."""
        out = np.full(len(keys), -1, np.int64)
        for have, slots in self.runs:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = have[at] == keys
            out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Slots for keys that are new and different, in their order."""
        slots = np.arange(self.size, self.size + len(keys))
        if not len(keys):  # a batch may bring nothing new; an empty run could not be searched
            return slots
        self.size += len(keys)
        run = (keys, slots)
        while self.runs and len(self.runs[-1][0]) <= 4 * len(run[0]):
            last = self.runs.pop()
            run = (np.concatenate([last[0], run[0]]), np.concatenate([last[1], run[1]]))
        order = np.argsort(run[0], kind="stable")
        self.runs.append((run[0][order], run[1][order]))
        return slots


def different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hash its number among the different ones; those; where each stands first."""
    codes, values = pd.factorize(h)
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, values, first


class Ids:
    """Id sequences by slot, in one growing pool."""

    def __init__(self, kind: str = "<u4") -> None:
        self.pool, self.used = np.zeros(1 << 16, kind), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used += len(flat)

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``slots`` end to end, and their lengths."""
        n = self.length[slots]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[slots] - ends + n, n)
        return self.pool[at], n
