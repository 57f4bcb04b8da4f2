"""Removing repeated passages: factoring documents against an indexed reference.

The reference of a document is every document with a smaller doc_id.  In the
manner of relative Lempel-Ziv parsing, a document is read as factors copied
from the reference and literal words between them; factors of at least
`window` words are removed.  The reference is indexed in blocks that Spark
shuffles by key, so that each document is parsed against all of them without
any block being broadcast or any pair of documents being formed:

1. *Anchors.*  Every window of 13 words has an anchor, the smallest hash of its
   5-word grams.  Equal windows have equal anchors, and neighbouring windows
   mostly share one, so about a fifth of the windows' number is shuffled into
   index blocks by anchor.  A block returns, per document, the anchors that
   other documents have too: only there can a factor begin.
2. *Factors.*  Windows with such an anchor are shuffled by a 96-bit fingerprint
   of their 13 words together with their doc_id; a block returns the positions
   whose fingerprint has a smaller doc_id elsewhere.  Runs of positions are the
   factors; windows across the boundary of two factors (copied from different
   documents) carry fingerprints of their own, so nothing is lost there.
3. The positions meet the texts again, and covered words are dropped.

Skew: an anchor or window that many documents of a slice share is settled
inside the slice; one representative of each slice reaches the index, so the
hottest passage has as many rows as there are slices of text, not documents.
Index blocks are sized by the bytes of text in the table.  The texts are
shuffled once by a key of the row; both joins read that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import NULL_ID, bounded_batches, row_key, text_bytes

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 16 << 20        # text behind one index block
NEW, KNOWN, PASS = 0, 1, 2


def _as(column, dtype) -> np.ndarray:
    """The binary values of a column joined into one array."""
    parts = [v for v in column.to_pylist() if v]
    return np.frombuffer(b"".join(parts), dtype) if parts else np.zeros(0, dtype)


def _runs(owner: np.ndarray):
    """(starts, lengths) of the runs of equal neighbours."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return start, np.diff(np.append(start, len(owner)))


def _changes(*keys) -> np.ndarray:
    """True where a row of sorted keys differs from the row before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def window_anchors(h: np.ndarray, upto: np.ndarray, window: int, gram: int):
    """(window starts, anchor of each, document of each) over the word hashes of a slice."""
    n, docs = len(h), len(upto) - 1
    sizes = np.diff(upto)
    doc = np.repeat(np.arange(docs), sizes)
    left = upto[1:][doc] - np.arange(n)                  # words from here to the document's end
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at = np.flatnonzero(left >= gram)
    low[at] = tv.gram_hash(h, at, gram)
    span, have = window - gram + 1, 1                    # sliding minimum over `span` grams, by doubling
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low, np.append(low[step:], np.full(min(step, n), np.iinfo(np.uint64).max, np.uint64))[:n])
        have += step
    starts = np.flatnonzero(left >= window)
    return starts, low[starts], doc[starts]


def _by_block(block: np.ndarray, doc: np.ndarray):
    """Order by block, then document; the blocks' bounds."""
    order = np.lexsort((doc, block))
    b = block[order]
    start, length = _runs(b)
    return order, b[start], start, start + length


def _owners(doc: np.ndarray, *columns):
    """Run-length code of the owners: counts, and each owner column once a run."""
    start, length = _runs(doc)
    return length.astype(np.uint32).tobytes(), [c[doc[start]].tobytes() for c in columns]


def anchor_rows(batches, blocks: int, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tv.slices(batch, "text"):
            rid = rows.column("rid").to_numpy(zero_copy_only=False)
            s, e, upto = tv.words(data, off)
            _, value, doc = window_anchors(tv.span_hash(data, s, e), upto, window, gram)
            change = _changes(value, doc)
            value, doc = value[change], doc[change]
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            change = _changes(value, doc)
            value, doc = value[change], doc[change]
            start, length = _runs(value)
            single = np.repeat(length == 1, length)
            out = []
            v, d = value[single], doc[single]
            order, ids, a, z = _by_block(v % np.uint64(blocks), d)
            v, d = v[order], d[order]
            for b, i, j in zip(ids.tolist(), a.tolist(), z.tolist()):
                counts, (own,) = _owners(d[i:j], rid)
                out.append((b, NEW, v[i:j].tobytes(), counts, own))
            v = value[start[length > 1]]
            order, ids, a, z = _by_block(v % np.uint64(blocks), v)
            for b, i, j in zip(ids.tolist(), a.tolist(), z.tolist()):
                out.append((b, KNOWN, v[order[i:j]].tobytes(), b"", b""))
            v, d = value[~single], doc[~single]
            order, ids, a, z = _by_block(rid[d].view(np.uint64) % np.uint64(blocks), d)
            v, d = v[order], d[order]
            for b, i, j in zip(ids.tolist(), a.tolist(), z.tolist()):
                counts, (own,) = _owners(d[i:j], rid)
                out.append((b, PASS, v[i:j].tobytes(), counts, own))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                                  *(pa.array(c, pa.binary()) for c in cols[2:])],
                                                 names=["block", "kind", "keys", "counts", "owners"])


def _packed(owner: np.ndarray, values: np.ndarray, blocks: int) -> pa.Table:
    """An answer by destination: one row for every block of owners, each holding
    its owners, their numbers of values and the values."""
    to = owner.view(np.uint64) % np.uint64(blocks)
    order = np.lexsort((owner, to))
    owner, values, to = owner[order], values[order], to[order]
    start, length = _runs(to)
    rows = []
    for i, j in zip(start.tolist(), (start + length).tolist()):
        a, n = _runs(owner[i:j])
        rows.append((int(to[i]), owner[i:j][a].tobytes(), n.astype(np.uint32).tobytes(), values[i:j].tobytes()))
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.table({"to": pa.array(cols[0], pa.int64()),
                     **{k: pa.array(c, pa.binary()) for k, c in zip(("owners", "counts", "found"), cols[1:])}})


PACKED = "to long, owners binary, counts binary, found binary"


def _per_owner(dtype):
    """The answers to one block of owners, as one row (rid, found) per owner."""
    def gathered(t: pa.Table) -> pa.Table:
        owner, values = np.repeat(_as(t["owners"], np.int64), _as(t["counts"], np.uint32)), _as(t["found"], dtype)
        order = np.argsort(owner, kind="stable")
        owner, values = owner[order], np.ascontiguousarray(values[order])
        start, _ = _runs(owner)
        return pa.table({"rid": pa.array(owner[start], pa.int64()),
                         "found": pa.array(tv.blobs(values, np.append(start, len(owner))), pa.binary())})
    return gathered


def _kind(t: pa.Table, kind: int) -> pa.Table:
    return t.filter(pa.compute.equal(t["kind"], kind))


def shared_anchors(t: pa.Table, blocks: int) -> pa.Table:
    """One index block: the anchors that more than one document holds, by document."""
    new, known, passed = (_kind(t, k) for k in (NEW, KNOWN, PASS))
    value, owner = _as(new["keys"], np.uint64), np.repeat(_as(new["owners"], np.int64), _as(new["counts"], np.uint32))
    distinct, at, n = np.unique(value, return_inverse=True, return_counts=True)
    shared = (n > 1) | np.isin(distinct, _as(known["keys"], np.uint64))
    hit = shared[at] if len(value) else np.zeros(0, bool)
    return _packed(np.concatenate([owner[hit], np.repeat(_as(passed["owners"], np.int64), _as(passed["counts"], np.uint32))]),
                   np.concatenate([value[hit], _as(passed["keys"], np.uint64)]), blocks)


def factor_rows(batches, blocks: int, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tv.slices(batch, "text"):
            rid, ident = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "ident"))
            s, e, upto = tv.words(data, off)
            h = tv.span_hash(data, s, e)
            start, value, doc = window_anchors(h, upto, window, gram)
            lists = rows.column("found").to_pylist()
            sizes = np.array([len(x) // 8 for x in lists], np.int64)
            known = np.frombuffer(b"".join(lists), np.uint64)
            key = lambda v, d: tv.mix(v + (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            hit = np.isin(key(value, doc), key(known, np.repeat(np.arange(len(rid)), sizes)))
            start, doc = start[hit], doc[hit]
            if not len(start):
                continue
            w1 = tv.gram_hash(h, start, window, 2)
            w2 = (tv.gram_hash(tv.span_hash(data, s, e, 3), start, window, 4) >> np.uint64(32)).astype(np.uint32)
            pos = (start - upto[doc]).astype(np.uint32)
            owner = ident[doc]
            order = np.lexsort((owner, w2, w1))
            w1, w2, pos, owner, doc = w1[order], w2[order], pos[order], owner[order], doc[order]
            first = np.flatnonzero(_changes(w1, w2))
            least = np.repeat(owner[first], np.diff(np.append(first, len(w1))))
            out = []
            later = owner > least                        # a smaller doc_id of this slice has the window
            p, d = pos[later], doc[later]
            order, ids, a, z = _by_block(rid[d].view(np.uint64) % np.uint64(blocks), d)
            p, d = p[order], d[order]
            for b, i, j in zip(ids.tolist(), a.tolist(), z.tolist()):
                counts, (own,) = _owners(d[i:j], rid)
                out.append((b, PASS, b"", b"", p[i:j].tobytes(), counts, own, b""))
            keep = ~later
            w1, w2, pos, doc = w1[keep], w2[keep], pos[keep], doc[keep]
            order, ids, a, z = _by_block(w1 % np.uint64(blocks), doc)
            w1, w2, pos, doc = w1[order], w2[order], pos[order], doc[order]
            for b, i, j in zip(ids.tolist(), a.tolist(), z.tolist()):
                counts, (own, idents) = _owners(doc[i:j], rid, ident)
                out.append((b, NEW, w1[i:j].tobytes(), w2[i:j].tobytes(), pos[i:j].tobytes(), counts, own, idents))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                              *(pa.array(c, pa.binary()) for c in cols[2:])],
                                             names=["block", "kind", "w1", "w2", "pos", "counts", "owners", "idents"])


def repeated_windows(t: pa.Table, blocks: int) -> pa.Table:
    """One block of fingerprints: positions whose window a smaller doc_id has, by document."""
    new, passed = _kind(t, NEW), _kind(t, PASS)
    counts = _as(new["counts"], np.uint32)
    w1, w2, pos = _as(new["w1"], np.uint64), _as(new["w2"], np.uint32), _as(new["pos"], np.uint32)
    owner, ident = (np.repeat(_as(new[c], np.int64), counts) for c in ("owners", "idents"))
    order = np.lexsort((ident, w2, w1))
    w1, w2, pos, owner, ident = w1[order], w2[order], pos[order], owner[order], ident[order]
    first = np.flatnonzero(_changes(w1, w2))
    later = ident > np.repeat(ident[first], np.diff(np.append(first, len(w1))))
    return _packed(np.concatenate([owner[later], np.repeat(_as(passed["owners"], np.int64), _as(passed["counts"], np.uint32))]),
                   np.concatenate([pos[later], _as(passed["pos"], np.uint32)]), blocks)


def kept_rows(batches, window: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tv.slices(batch, "text"):
            s, e, upto = tv.words(data, off)
            n = np.diff(upto)
            lists = [x or b"" for x in rows.column("found").to_pylist()]
            sizes = np.array([len(x) // 4 for x in lists], np.int64)
            start = np.frombuffer(b"".join(lists), np.uint32).astype(np.int64) + np.repeat(upto[:-1], sizes)
            cover = np.zeros(len(s) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            a, z = tv.edges_of(gone, upto)               # factors, never across documents
            owner = np.searchsorted(upto, a, side="right") - 1
            factors = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(a, upto).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array((a - upto[owner]).astype(np.int32)), pa.array((z - upto[owner]).astype(np.int32))],
                                           names=["start", "end"]))
            ks, ke = s[~gone], e[~gone]
            kept = np.concatenate([[0], np.cumsum(~gone)])[upto]
            text = tv.gather(np.append(data, np.uint8(32)), ks, ke - ks + 1)
            ends = np.cumsum(ke - ks + 1)
            text[ends - 1] = 32
            full = kept[:-1] < kept[1:]
            use = np.ones(len(text), bool)
            use[ends[kept[1:][full] - 1] - 1] = False    # no space after a document's last word
            size = np.concatenate([[0], ends])[kept]
            size = size - np.concatenate([[0], np.cumsum(full)])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), pa.array(n.astype(np.int64)), pa.array((n - np.diff(kept)).astype(np.int64)),
                 factors, tv.strings(text[use], size).cast(pa.string())],
                names=[*keep, "n_words", "n_removed", "factors", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, factors (array of word ranges
    start, end that were removed), kept_text (the other words, one space between).

    A word goes if a window of `window` consecutive words covers it whose word
    sequence also starts in a document with a smaller doc_id.  A null doc_id
    counts as larger than every other; documents of equal doc_id (repeated rows)
    do not remove each other's words.  A null text has no words; other columns
    are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    src = src.withColumn("rid", row_key())
    blocks = text_bytes(src) // block_bytes + 1

    anchors = (src.select("rid", "text")
               .mapInArrow(lambda it: anchor_rows(it, blocks, window, gram),
                           "block long, kind int, keys binary, counts binary, owners binary")
               .groupBy("block").applyInArrow(lambda t: shared_anchors(t, blocks), PACKED)
               .groupBy("to").applyInArrow(_per_owner(np.uint64), "rid long, found binary"))
    positions = (src.join(anchors, "rid").select("rid", F.coalesce("doc_id", F.lit(NULL_ID)).alias("ident"), "text", "found")
                 .mapInArrow(lambda it: factor_rows(it, blocks, window, gram),
                             "block long, kind int, w1 binary, w2 binary, pos binary, counts binary, owners binary, idents binary")
                 .groupBy("block").applyInArrow(lambda t: repeated_windows(t, blocks), PACKED)
                 .groupBy("to").applyInArrow(_per_owner(np.uint32), "rid long, found binary"))
    return (src.join(positions, "rid", "left").select("doc_id", "text", "found")
            .mapInArrow(lambda it: kept_rows(it, window, ["doc_id"]),
                        "doc_id long, n_words long, n_removed long, factors array<struct<start:int,end:int>>, kept_text string"))


def op10_substrings(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
