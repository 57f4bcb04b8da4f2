"""Vectorised text helpers used inside Arrow tasks.

A batch of texts is one flat byte array plus document offsets (the buffers
Arrow already holds), so splitting, hashing and gathering words are numpy
passes over the bytes instead of Python loops over words.  Memory is bounded:
`slices` cuts a batch into pieces of at most `budget` bytes (a longer single
document is a piece of its own).

Words are the runs `[^\\x20\\x09-\\x0D]+`; the separators are ASCII, so the rule
holds on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def process_store() -> dict:
    """A dict that lives as long as the Python worker: caches survive from task to task."""
    mod = sys.modules.get("_wavepanel_worker_store")
    if mod is None:
        mod = sys.modules["_wavepanel_worker_store"] = types.ModuleType("_wavepanel_worker_store")
        mod.store = {}
    return mod.store


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    store = process_store()
    if "libc" not in store:
        try:
            store["libc"] = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):           # another C library: nothing to ask for
            store["libc"] = lambda _: 0
    store["libc"](0)


def text_column(batch, name: str) -> pa.Array:
    """The column as a non-null string array (a null text is an empty one)."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def slices(batch, name: str, budget: int = SLICE_BYTES):
    """Yield (rows, bytes, offsets): consecutive row slices of `batch` with the
    flat UTF-8 bytes of column `name` and the documents' offsets in them."""
    col = text_column(batch, name)
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + budget, side="right")) - 1)
        yield batch.slice(a, b - a), data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b
    release()


def edges_of(inside: np.ndarray, off: np.ndarray):
    """Starts and ends of the runs of True, broken at document offsets."""
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, off: np.ndarray):
    """(starts, ends, document offsets in the word list) of all words."""
    s, e = edges_of(~SEPARATOR[data], off)
    return s, e, np.searchsorted(s, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(base: int, n: int):
    """Powers of an odd base and of its inverse modulo 2^64, kept per worker."""
    store = process_store().setdefault("powers", {})
    got = store.get(base)
    if got is None or len(got[0]) < n:
        size = max(1, (n + (1 << 18) - 1) >> 18) << 18        # as long as needed so far, rounded up
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        got = store[base] = tuple(out)
    return got


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span, by one prefix sum."""
    p, inv = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * p[:len(values)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


def _byte_codes(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of the bytes of every span; the length takes part."""
    base = 0x2545F4914F6CDD1D + 2 * seed
    return mix(rolling(_byte_codes(seed)[data], s, e, base) + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))


def gram_hash(h: np.ndarray, starts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of k consecutive word hashes from each start."""
    return rolling(h, starts, starts + k, 0xD1342543DE82EF95 + 2 * seed)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, joined."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(first, counts)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start+length] for every pair, joined."""
    first = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)]


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """UTF-8 bytes plus offsets as a string array (offsets beyond 2^31 become a large one)."""
    if len(data) < (1 << 31) - 1:
        return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def blobs(values: np.ndarray, off: np.ndarray) -> list[bytes]:
    """One bytes object per span of `values`."""
    raw = np.ascontiguousarray(values)
    return [raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
