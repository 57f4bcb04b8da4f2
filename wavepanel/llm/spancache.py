"""A per-worker cache from span hashes to short integer sequences (token ids).

Natural text repeats its words, so a tokenizer only has to see each distinct
word once per worker.  Keys are 64-bit span hashes kept sorted; values are one
flat array.  The cache holds at most `limit` spans and starts afresh beyond.
"""

from __future__ import annotations

import numpy as np


class _Level:
    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def find(self, keys):
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys, start, count):
        keys, start, count = (np.concatenate(x) for x in ((self.keys, keys), (self.start, start), (self.count, count)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.count = keys[order], start[order], count[order]


class SpanCache:
    def __init__(self, dtype, limit: int = 1_000_000):
        self.dtype, self.limit = dtype, limit
        self._reset()

    def _reset(self):
        self.main, self.recent = _Level(), _Level()
        self.values, self.used = np.zeros(1 << 16, self.dtype), 0

    def fetch(self, keys: np.ndarray, make):
        """keys: distinct hashes.  make(indices of the missing keys) -> list of id
        sequences.  Returns (starts, counts) into `self.values`."""
        if len(self.main.keys) + len(self.recent.keys) + len(keys) > self.limit:
            self._reset()
        start, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        missing = np.ones(len(keys), bool)
        for level in (self.main, self.recent):
            at, hit = level.find(keys)
            hit &= missing
            start[hit], count[hit] = level.start[at[hit]], level.count[at[hit]]
            missing &= ~hit
        if missing.any():
            index = np.flatnonzero(missing)
            made = make(index)
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            total = int(lengths.sum())
            while self.used + total > len(self.values):
                self.values = np.concatenate([self.values, np.zeros(len(self.values), self.dtype)])
            if total:
                self.values[self.used:self.used + total] = np.concatenate([np.asarray(m, self.dtype) for m in made]) \
                    if isinstance(made[0], np.ndarray) else np.fromiter((i for m in made for i in m), self.dtype, total)
            first = self.used + np.cumsum(lengths) - lengths
            self.used += total
            start[index], count[index] = first, lengths
            self.recent.add(keys[index], first, lengths)
            if len(self.recent.keys) > max(100_000, len(self.main.keys) // 4):
                self.main.add(self.recent.keys, self.recent.start, self.recent.count)
                self.recent = _Level()
        return start, count
