"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a chunk the table holds the last token of that prefix's
encoding.  Candidates are the vocabulary pieces that end there (an
Aho-Corasick automaton); the last token of a prefix is the one candidate that
is *compatible* with the last token of the prefix before it, i.e. merging the
two pieces' characters together yields just these two pieces.  The ids are then
read backwards from the end of the table.  Characters outside the vocabulary
become their UTF-8 byte pieces.

A text is cut into chunks between characters that stand side by side in no
vocabulary piece (a rule read off the vocabulary; in particular before a run of
spaces), where no merge can cross; a worker encodes each distinct chunk once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import bounded_batches
from .spancache import SpanCache

SPACE = "▁"
END_ID = 2


class PrefixTable:
    """Encoder and decoder over the pieces of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        special = [i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        skip = set(special) | set(self.byte_id.values())
        self.piece = [sp.id_to_piece(i) for i in range(self.size)]
        self.length = [len(p) for p in self.piece]
        self.score = {self.piece[i]: sp.get_score(i) for i in range(self.size) if i not in skip}
        self.id = {self.piece[i]: i for i in range(self.size) if i not in skip}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self.merged(list(p)) == [p]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self._byte_tables(skip)

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, best score first and leftmost on ties, until none is a piece."""
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            x, y = self.piece[a], self.piece[b]
            ok = self.pairs[key] = self.merged(list(x + y)) == [x, y]
        return ok

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a chunk whose spaces are already SPACE marks."""
        whole = self.id.get(text)
        last = [-1] * len(text)
        length, pairs, compatible = self.length, self.pairs, self.compatible
        for end, i in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - length[i]
            if before < 0:
                last[end] = i
            else:
                p = last[before]
                if p < 0:
                    last[end] = i
                else:
                    ok = pairs.get(p << 20 | i)
                    if ok is None:
                        ok = compatible(p, i)
                    if ok:
                        last[end] = i
            if end == len(text) - 1 and last[end] == whole and whole is not None:
                return [whole]
        out, at = [], len(text) - 1
        while at >= 0:
            i = last[at]
            if i < 0:
                out.extend(self.byte_id[b] for b in reversed(text[at].encode()))
                at -= 1
            else:
                out.append(i)
                at -= length[i]
        out.reverse()
        return out

    def _byte_tables(self, skip):
        """Which byte pairs a piece can hold across a character boundary; the bytes of every id."""
        joined = np.zeros((256, 256), bool)
        out = []
        for i, p in enumerate(self.piece):
            if i in skip:
                out.append(b"")
                continue
            raw = [c.replace(SPACE, " ").encode() for c in p]
            for x, y in zip(raw[:-1], raw[1:]):
                joined[x[-1], y[0]] = True
            out.append(b"".join(raw))
        for b, i in self.byte_id.items():
            out[i] = bytes([b])
        joined[:, 0x80:0xC0] = True                       # inside a character
        mark = SPACE.encode()                             # a literal mark counts as a space: cut neither before nor after
        joined[:, mark[0]] = joined[mark[-1], :] = True
        self.joined = joined
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.byte_count = np.array([len(b) for b in out], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count

    def encode(self, data: np.ndarray, off: np.ndarray, cache: SpanCache):
        """(ids, offsets) of the documents, without end ids."""
        sizes = np.diff(off)
        full = sizes > 0
        # the dummy prefix: one space before every document that is not empty
        shift = np.cumsum(full)
        buf = np.full(len(data) + int(full.sum()), 32, np.uint8)
        buf[np.arange(len(data)) + np.repeat(shift, sizes)] = data
        off = np.concatenate([[0], np.cumsum(sizes + full)])
        cut = np.ones(len(buf), bool)
        cut[1:] = ~self.joined[buf[:-1], buf[1:]]
        cut[off[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        keys, first, inverse = np.unique(tv.span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()

        def make(index):
            encode = self.encode_chunk
            return [encode(raw[starts[k]:ends[k]].decode().replace(" ", SPACE)) for k in first[index]]

        at, count = cache.fetch(keys, make)
        count_each = count[inverse]
        ids = tv.gather(cache.values, at[inverse], count_each)
        upto = np.concatenate([[0], np.cumsum(count_each)])
        return ids, upto[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray):
        """(bytes, offsets) of the documents' decoded texts; end ids carry no bytes."""
        data = tv.gather(self.bytes, self.byte_start[ids], self.byte_count[ids])
        upto = np.concatenate([[0], np.cumsum(self.byte_count[ids])])[off]
        lead = (upto[:-1] < upto[1:])
        lead[lead] = data[upto[:-1][lead]] == 32           # the dummy prefix goes
        keep = np.ones(len(data), bool)
        keep[upto[:-1][lead]] = False
        return data[keep], upto - np.concatenate([[0], np.cumsum(lead)])


def load(path: str) -> tuple[PrefixTable, SpanCache]:
    store = tv.process_store()
    if ("pieces", path) not in store:
        store["pieces", path] = PrefixTable(path), SpanCache(np.int32)
    return store["pieces", path]


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns in `keep`, ids (array<int>, with an end id) and
    decoded (the text of decode(ids)).

    Exactly the library's ids for a BPE model with byte fallback, identity
    normalisation and a dummy prefix.  A null text is an empty one: its ids are
    the end id alone, decoded is ''.  Rows are independent (one narrow pass, no
    shuffle); repeated rows give repeated results; an empty table gives none.
    `model` is a path readable on the executors.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = src.drop("__text").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = load(model)
        for batch in batches:
            for rows, data, off in tv.slices(batch, "__text"):
                ids, upto = table.encode(data, off, cache)
                n = len(off) - 1
                full = np.full(len(ids) + n, END_ID, np.int32)
                full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(upto))] = ids
                upto = upto + np.arange(n + 1)
                decoded = tv.strings(*table.decode(full, upto))
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(full))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists, decoded.cast(pa.string())],
                                                 names=[*keep, "ids", "decoded"])

    return src.mapInArrow(run, schema)


def op9_pieces(docs: DataFrame, model: str) -> DataFrame:
    out = encode_decode(docs, model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
