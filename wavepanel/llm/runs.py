"""Periodic runs of words, found on an enhanced suffix array.

A run is a maximal stretch of words with smallest period q that is at least
`min_length` words and `min_exponent` periods long.  A run with period q that
ends before position e holds exactly one square aa, |a| = q, that cannot be
moved right (a *branching* square, at e - 2q): a is then an LCP interval of
depth q.  So for every LCP interval of depth q the suffixes i of all children
but the largest are tested: i + q (or i - q) stands in the same interval by its
rank, and the words after the two copies differ.  Each suffix is in a smaller
child O(log n) times, so there are O(n log n) tests.  Squares are then rotated
left as far as their words agree, which gives the run; squares of a power of a
shorter word end where that word's run ends and are covered by it.

Intervals are positions of the LCP array with their nearest smaller
neighbours; there are no tree nodes.  Documents share one array per slice of
text, held apart by unique separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import bounded_batches

MIN_LENGTH, MIN_EXPONENT = 6, 4
EXPAND = 1 << 20                 # suffixes tested at a time
CELLS = 1 << 18                  # symbols compared at a time
RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())


def suffix_array(text: np.ndarray):
    """(suffix array, ranks) by prefix doubling; only suffixes not told apart so far are sorted again."""
    n = len(text)
    sa = np.argsort(text, kind="stable").astype(np.int32)
    head = np.ones(n, bool)
    head[1:] = text[sa[1:]] != text[sa[:-1]]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    active, h = np.flatnonzero(~(head & np.append(head[1:], True))), 1
    while len(active):
        at = sa[active]
        key = rank[at].astype(np.int64) * n + rank[at + h]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[active] = at
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, active, 0))
        active = active[~(head & np.append(head[1:], True))]
        h *= 2
    return sa, rank


def agree(text: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from i and j on agree, going right (step 1) or left (-1).
    Unique symbols at both ends of `text` stop every pair with i != j."""
    same, open_, width = np.zeros(len(i), np.int64), np.arange(len(i)), 1
    while len(open_):
        w = max(1, min(width, CELLS // len(open_)))
        reach = (same[open_, None] + np.arange(w)) * step
        last = len(text) - 1
        hit = text[np.clip(i[open_, None] + reach, 0, last)] == text[np.clip(j[open_, None] + reach, 0, last)]
        full = hit.all(axis=1)
        same[open_] += np.where(full, w, hit.argmin(axis=1))
        open_, width = open_[full], width * 2
    return same


def lcp_array(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in `sa`.  Where the
    symbols before both agree, it is one less than at the position before; only
    the rest is compared (O(n log n) symbols in all)."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    own = (before <= 0) | (here == 0)
    own[1:] |= text[:-1] != text[before[1:] - 1]
    value = np.zeros(n, np.int64)
    ask = np.flatnonzero(own & (before >= 0))
    value[ask] = agree(text, ask, before[ask], 1)
    last = np.maximum.accumulate(np.where(own, here, 0))
    return (value[last] + last - here)[sa].astype(np.int32)


def smaller(v: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """Nearest position on one side (step -1 or 1) with a smaller value (or, not
    strict, one not larger), for all positions with v > 0, by jumping along
    pointers that only ever skip larger values."""
    to = np.arange(len(v)) + step
    open_ = np.flatnonzero(v > 0)
    while len(open_):
        at = to[open_]
        more = v[at] >= v[open_] if strict else v[at] > v[open_]
        open_ = open_[more]
        to[open_] = to[at[more]]
    return to


def branching_squares(text: np.ndarray, sa: np.ndarray, lcp: np.ndarray, min_length: int, min_exponent: int):
    """(ends, periods) of all branching squares that a long enough run can have."""
    # a run's word occurs at least min_exponent times, and some neighbours of its group share this much
    starts = np.flatnonzero(lcp == 0)
    deep = np.maximum.reduceat(lcp, starts) > min_length * (min_exponent - 2) // min_exponent
    keep = np.repeat(deep, np.diff(np.append(starts, len(lcp))))
    sa, v = sa[keep], np.append(lcp[keep], 0)
    place = np.full(len(text), -1, np.int32)
    place[sa] = np.arange(len(sa), dtype=np.int32)
    at = np.flatnonzero(v > 0)
    right, after = smaller(v, 1, True), smaller(v, 1, False)
    left, back = smaller(v, -1, True), smaller(v, -1, False)
    first = np.zeros(len(v), bool)
    first[at] = v[back[at]] < v[at]                        # leftmost boundary of its interval
    root = np.where(first | (v == 0), np.arange(len(v)), back)
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    lead = np.flatnonzero(first)
    child = np.concatenate([at, left[lead]])
    size = np.concatenate([after[at], lead]) - child
    owner = np.concatenate([root[at], lead])
    order = np.lexsort((size, owner))
    child, size, owner = child[order], size[order], owner[order]
    small = np.zeros(len(owner), bool)
    small[:-1] = owner[:-1] == owner[1:]                   # the last, largest child of each interval is left out
    small &= right[owner] - left[owner] >= min_exponent
    child, size, owner = child[small], size[small], owner[small]
    ends, periods = [], []
    upto = np.cumsum(size)
    a = 0
    while a < len(child):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + EXPAND, side="right")))
        count = size[a:b]
        i = tv.gather(sa, child[a:b], count).astype(np.int64)
        low, high, q = (np.repeat(x[owner[a:b]], count) for x in (left, right, v))
        q = q.astype(np.int64)
        for far in (i + q, i - q):                          # the other copy of the interval's word
            ok = (far >= 0) & (far < len(text))
            rank = place[np.where(ok, far, 0)]
            ok &= (rank >= low) & (rank < high)
            second = np.maximum(i, far)[ok]
            ok_q = q[ok]
            turn = text[second] != text[second + ok_q]
            ends.append((second + ok_q)[turn])
            periods.append(ok_q[turn])
        a = b
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(ends) * len(text) + np.concatenate(periods))
    return pairs // len(text), pairs % len(text)


def runs_of(text: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
    """(starts, lengths, periods) of the runs in `text`, by start and period.
    `text` begins and ends with symbols that occur once."""
    sa, _ = suffix_array(text)
    lcp = lcp_array(text, sa)
    end, period = branching_squares(text, sa, lcp, min_length, min_exponent)
    found = []
    while len(end):                                        # by end, then period: the shortest of each end is primitive
        lead = np.ones(len(end), bool)
        lead[1:] = end[1:] != end[:-1]
        e, q = end[lead], period[lead]
        i = e - 2 * q
        start = i - agree(text, i - 1, i + q - 1, -1)
        found.append((start, e - start, q))
        of = np.cumsum(lead) - 1
        rest = ~lead & ((period % q[of] != 0) | (2 * period > (e - start)[of]))
        end, period = end[rest], period[rest]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    start, length, q = (np.concatenate(c) for c in zip(*found))
    long = (length >= min_length) & (length >= min_exponent * q)
    start, length, q = start[long], length[long], q[long]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def looped(bounds: np.ndarray, seeds: list) -> np.ndarray:
    """For every word the number of the word that stands there: documents whose
    seed is divisible by 10 repeat a stretch from some word on."""
    source = np.arange(int(bounds[-1]))
    for d, h in enumerate(seeds):
        n = int(bounds[d + 1] - bounds[d])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[bounds[d] + a:bounds[d + 1]] = bounds[d] + a + np.arange(n - a) % p
    return source


def slice_runs(data: np.ndarray, off: np.ndarray, seeds: list | None, min_length: int, min_exponent: int):
    """Runs and collapsed texts of the documents of a slice:
    (runs per document, starts, lengths, periods, bytes of the kept words, their offsets)."""
    s, e, bounds = tv.words(data, off)
    docs = len(off) - 1
    source = looped(bounds, seeds) if seeds is not None else np.arange(len(s))
    s, e = s[source], e[source]
    count = np.diff(bounds)
    doc = np.repeat(np.arange(docs), count)
    key = tv.mix(tv.span_hash(data, s, e) + tv.mix(doc.astype(np.uint64) + np.uint64(1)))
    symbols, number = np.unique(key, return_inverse=True)
    place = np.arange(len(s)) + doc + 1                    # words between separators
    text = np.empty(len(s) + docs + 1, np.int32)
    separator = np.ones(len(text), bool)
    separator[place] = False
    text[place] = number
    text[separator] = len(symbols) + np.arange(docs + 1)
    start, length, q = runs_of(text, min_length, min_exponent)
    of = np.searchsorted(np.flatnonzero(separator), start) - 1
    word = start - of - 1
    change = np.zeros(len(s) + 1, np.int64)
    np.add.at(change, word + q, 1)
    np.add.at(change, word + length, -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    size = e[kept] - s[kept] + 1                           # every word with one space after it
    upto = np.concatenate([[0], np.cumsum(size)])
    out = tv.gather(np.append(data, np.uint8(32)), s[kept], size)
    out[upto[1:] - 1] = 32
    edge = upto[np.searchsorted(kept, bounds)]
    full = edge[:-1] < edge[1:]
    keep = np.ones(len(out), bool)
    keep[edge[1:][full] - 1] = False                       # but none after a document's last word
    return (np.bincount(of, minlength=docs), word - bounds[of], length, q,
            out[keep], edge - np.concatenate([[0], np.cumsum(full)]))


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", seed: Column | None = None,
              min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per document: the columns in `keep`, runs (array of start, length, period
    in words, by start, then period) and collapsed (the words that no run holds
    after its first period, joined by one space).

    `seed`, if given, is a column whose value edits the text first (see `looped`;
    null: no edit).  A null text is an empty one; a text without words has no
    runs and an empty collapsed text.  Rows are independent (one narrow pass, no
    shuffle): repeated rows give repeated results, an empty table gives none,
    other columns are not read.  Memory follows a slice of text, or the longest
    single document.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"),
                      *([seed.alias("__seed")] if seed is not None else []))
    edited = seed is not None
    schema = T.StructType([src.schema[c] for c in keep]).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in tv.slices(batch, "__text"):
                seeds = rows.column(rows.num_columns - 1).to_pylist() if edited else None
                per, start, length, q, out, edge = slice_runs(data, off, seeds, min_length, min_exponent)
                found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, q)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], lists, tv.strings(out, edge).cast(pa.string())],
                                                 names=[*keep, "runs", "collapsed"])

    return src.mapInArrow(run, schema)


def op11_runs(docs: DataFrame) -> DataFrame:
    """Runs of the looped texts: their number, the one of greatest exponent, digests."""
    got = find_runs(docs, seed=F.crc32(F.col("`doc_id`").cast("string").cast("binary")))
    # runs stand by start, then period: a later run wins only by a strictly greater exponent
    best = F.reduce("runs", F.expr("cast(null as struct<start: bigint, length: bigint, period: bigint>)"),
                    lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    got = got.select("doc_id", "runs", "collapsed", best.alias("best"), F.array_join(line, "\n").alias("lines"))
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                      F.col("best.period").alias("period"),
                      F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                      F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))
