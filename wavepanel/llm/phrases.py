"""Document fingerprints by locally consistent parsing.

A text is cut into phrases of two to four symbols by deterministic coin
tossing: each symbol is relabelled by the lowest bit in which it differs from
the one before (and that bit's value), which leaves neighbours distinct and
shrinks the alphabet to six after a few tosses; labels 5, 4 and 3 are then
replaced by the smallest label that no neighbour has, and phrases begin at
local maxima.  Equal neighbours are first drawn together into one symbol.  A
phrase's name is a hash of its symbols, and the names are the symbols of the
next level.  Where a phrase begins depends on a few symbols around it alone, so
equal substrings get the same phrases but for a few at their ends, wherever
they stand.

A document's fingerprint is a minhash sketch of its set of names of the levels
in `LEVELS` (phrases of about 6 and 14 bytes), a byte per slot, in hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import bounded_batches, stored

SLOTS = 96
LEVELS = (1, 2)                       # which levels' names are sketched, from 0
U32, U64 = np.uint32, np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
SLICE = 1 << 19                       # bytes of text parsed at a time


def _tosses(bits: int) -> np.ndarray:
    """Label of every (symbol before, symbol) pair: 2 * (lowest differing bit) + that bit of the symbol."""
    a = np.arange(1 << bits)
    d = a[:, None] ^ a[None, :]
    low = np.bitwise_count((d & -d) - (d > 0)) * (d > 0)
    return (2 * low + ((a[None, :] >> low) & 1)).astype(np.uint8).ravel()


def _recolour(label: int) -> np.ndarray:
    """For every (left, own, right) of labels 0 to 7: `label` becomes the smallest one that no neighbour has."""
    left, own, right = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    free = np.select([(left != c) & (right != c) for c in range(3)], list(range(3)))
    return np.where(own == label, free, own).astype(np.uint8).ravel()


def _tables() -> dict:
    got = tv.process_store()
    if "phrases" not in got:
        r = np.random.default_rng(20_011)
        got["phrases"] = {"toss": {b: _tosses(b) for b in (8, 7, 4)}, "colour": [_recolour(c) for c in (5, 4, 3)],
                          "codes": tv.mix(np.arange(1, 257, dtype=U64) * GOLD),
                          "factor": r.integers(0, 1 << 32, SLOTS, dtype=U32) | U32(1), "offset": r.integers(0, 1 << 32, SLOTS, dtype=U32)}
    return got["phrases"]


def _toss(x: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    pair = np.zeros(len(x), np.uint16)
    pair[1:] = x[:-1]
    pair <<= bits
    pair |= x
    out = _tables()["toss"][bits][pair]
    out[first] = x[first] & 1
    return out


def labels(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Labels 0, 1, 2, neighbours distinct, of symbols (uint8 or uint64) whose
    neighbours are distinct; `first` and `last` are the ends of the documents."""
    if x.dtype == np.uint8:
        y = _toss(x, first, 8)
    else:
        d = x[1:] ^ x[:-1]
        low = np.zeros(len(x), U64)
        low[1:] = np.bitwise_count((d & (~d + U64(1))) - U64(1)) & 63
        y = (U64(2) * low + ((x >> low) & U64(1))).astype(np.uint8)
        y[first] = (x[first] & U64(1)).astype(np.uint8)
        y = _toss(y, first, 7)
    y = _toss(_toss(y, first, 4), first, 4)
    for table in _tables()["colour"]:
        near = np.zeros(len(y), np.uint16)
        near[1:] = y[:-1]
        near[first] = 7
        near <<= 3
        near |= y
        near <<= 3
        right = np.empty(len(y), np.uint8)
        right[:-1] = y[1:]
        right[last] = 7
        near |= right
        y = table[near]
    return y


def next_level(symbol: np.ndarray, name: np.ndarray, off: np.ndarray):
    """Names of the phrases and their document offsets, from a level's symbols and their names."""
    if not len(symbol):
        return name, off
    full = off[:-1] < off[1:]
    new = np.ones(len(symbol), bool)
    new[1:] = symbol[1:] != symbol[:-1]
    new[off[:-1][full]] = True
    if not new.all():                                      # equal neighbours become one symbol named by their number
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(symbol)))
        symbol, name = symbol[at], name[at]
        many = count > 1
        name[many] = tv.mix(name[many] + count[many].astype(U64) * GOLD)
        off = np.searchsorted(at, off)
    first, last = off[:-1][full], off[1:][full] - 1
    y = labels(symbol, first, last)
    top = np.zeros(len(y), bool)
    top[1:-1] = (y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])
    top[last] = False
    top[first] = True
    start = np.flatnonzero(top)
    end = np.append(start[1:], len(y))
    made = tv.rolling(name, start, end, 0xD1342543DE82EF95)
    return tv.mix(made + (end - start).astype(U64) * GOLD), np.searchsorted(start, off)


def phrase_levels(data: np.ndarray, off: np.ndarray, count: int):
    """[(names, document offsets)] of the first `count` levels over UTF-8 bytes."""
    out = [next_level(data, _tables()["codes"][data], off)]
    while len(out) < count:
        name, at = out[-1]
        out.append(next_level(name, name, at))
    return out


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of SLOTS bytes per document; zeros, which no text has, for an empty one."""
    levels = phrase_levels(data, off, max(LEVELS) + 1)
    used = [levels[k] for k in LEVELS]
    counts = [np.diff(o) for _, o in used]
    at = np.concatenate([[0], np.cumsum(sum(counts))])
    names = np.empty(int(at[-1]), U32)
    done = at[:-1].copy()
    for (name, o), n in zip(used, counts):
        names[np.repeat(done - o[:-1], n) + np.arange(len(name))] = (name >> U64(32)).astype(U32)
        done += n
    out = np.zeros((len(off) - 1, SLOTS), np.uint8)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        tables, edge, buf = _tables(), at[some], np.empty(len(names), U32)
        for k in range(SLOTS):
            np.multiply(names, tables["factor"][k], out=buf)
            buf += tables["offset"][k]
            least = np.minimum.reduceat(buf, edge)
            out[some, k] = 1 + ((least ^ (least >> U32(15))) * U32(0x2C1B3C6D) >> U32(12)) % U32(255)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of phrases that two texts have in common, relative to the mean of
    their numbers (Dice), estimated from sketches; 1 for equal sketches."""
    part = ((a == b).mean(axis=-1) - 1 / 255) / (1 - 1 / 255)   # a byte agrees by chance once in 255
    part = np.clip(part, 0, 1)
    return 2 * part / (1 + part)


def likeness_of(a: Column, b: Column) -> Column:
    """The same from two fingerprint columns, with SQL functions."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)),
                           lambda i: F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2))))
    part = F.greatest((same / F.lit(float(SLOTS)) - 1 / 255) / (1 - 1 / 255), F.lit(0.0))
    return 2 * part / (1 + part)


def _hex(sketch: np.ndarray) -> pa.Array:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    text = np.stack([digits[sketch >> 4], digits[sketch & 15]], axis=-1).reshape(-1)
    return tv.strings(text, np.arange(len(sketch) + 1) * (2 * SLOTS)).cast(pa.string())


def _chars(data: np.ndarray, off: np.ndarray):
    """(byte positions of the code points, one past the end last; documents' offsets among them)."""
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return at, np.searchsorted(at, off)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per document: the columns in `keep`, n_chars (code points) and fingerprint.

    A null text is an empty one (its fingerprint is all zeros).  Equal texts have
    equal fingerprints; rows are independent (one narrow pass, no shuffle), so
    repeated rows give repeated results and an empty table none.  Other columns
    are not read.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep]).add("n_chars", T.LongType()).add("fingerprint", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in tv.slices(batch, "__text", SLICE):
                _, chars = _chars(data, off)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.diff(chars)), _hex(sketches(data, off))],
                                                 names=[*keep, "n_chars", "fingerprint"])

    return src.mapInArrow(run, schema)


FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against_next(ids: pa.Array, data: np.ndarray, off: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[pa.Array]:
    """Columns of FOUND for documents `one`, each followed by document `two`."""
    sketch = sketches(data, off)
    at, chars = _chars(data, off)
    size = np.diff(chars)
    cut = size[one] // 3
    ends = at[chars[one] + size[one] - cut]
    heads = at[chars[two] + np.minimum(cut, size[two])]
    raw = data.tobytes()
    texts = [raw[a:b] + raw[c:d] for a, b, c, d in zip(off[one].tolist(), ends.tolist(), off[two].tolist(), heads.tolist())]
    whole = np.frombuffer(b"".join(texts), np.uint8)
    edited = sketches(whole, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    return [ids.take(pa.array(one)), pa.array(size[one]), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            _hex(sketch[one]), _hex(edited), pa.array(likeness(sketch[one], edited)), pa.array(likeness(sketch[one], sketch[two]))]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: a FOUND row for every document but the last
    (role 0), the last with its text (role 1), and the first's text (role 2)."""
    part = TaskContext.get().partitionId()
    held = None                                            # (id, bytes) of the document that waits for its successor

    def marked(role: int, doc) -> pa.RecordBatch:
        columns = [doc[0], pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2,
                   pa.array([part], pa.int32()), pa.array([role], pa.int32()), pa.array([doc[1].decode()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "role", "text"]
    for batch in batches:
        for rows, data, off in tv.slices(batch, "__text", SLICE):
            ids = rows.column(0)
            if held is None:
                yield marked(2, (ids.slice(0, 1), data[:off[1]].tobytes()))
            else:
                ids = pa.concat_arrays([held[0], ids])
                data = np.concatenate([np.frombuffer(held[1], np.uint8), data])
                off = np.concatenate([[0], off + len(held[1])])
            n = len(off) - 2
            held = (ids.slice(n, 1), data[off[n]:].tobytes())
            if n:
                found = _against_next(ids, data, off, np.arange(n), np.arange(1, n + 1))
                yield pa.RecordBatch.from_arrays([*found, pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)),
                                                  pa.nulls(n, pa.string())], names=names)
    if held is not None:
        yield marked(1, held)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of (doc_id, own text, next text)."""
    for batch in batches:
        for row in range(batch.num_rows):
            own, other = (tv.text_column(batch.slice(row, 1), c)[0].as_py().encode() for c in ("text", "next_text"))
            columns = _against_next(batch.column(0).slice(row, 1), np.frombuffer(own + other, np.uint8),
                                    np.array([0, len(own), len(own) + len(other)]), np.array([0]), np.array([1]))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint",
                                                             "edited_fingerprint", "near_edited", "near_next"])


def op12_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    The order is descending doc_id (null last; rows of one id by a hash of their
    text, equal rows side by side); each document is followed by the next one,
    the last by the first, a single document by itself.  Texts are shuffled
    once, by ranges that also split repeated ids and rows; each task holds a
    slice of text or one document, and the documents at the edges of the
    partitions are paired by a join of a row per partition.
    """
    bounded_batches(docs.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.col("__hash")]
    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("__text"))
    src = src.withColumn("__hash", F.xxhash64("__text")).withColumn("__row", F.monotonically_increasing_id())
    src = src.repartitionByRange(*order, F.col("__row")).sortWithinPartitions(*order)
    found = stored(src.select("doc_id", "__text").mapInArrow(_within, FOUND + ", part int, role int, text string"), "phrases")
    heads = found.where("role = 2").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # one row per partition
    turn = heads.select(F.col("next_part").alias("part")).select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    last = found.where("role = 1").select("doc_id", "part", "text").join(turn, "part").join(heads, "next_part")
    edge = last.select("doc_id", "text", "next_text").mapInArrow(_between, FOUND)
    columns = [f.split()[0] for f in FOUND.split(", ")]
    return found.where("role = 0").select(*columns).unionByName(edge)
