"""Token ids in Arrow files: fixed-size-list batches with random access.

Documents are range-partitioned by doc_id and sorted, so partition k holds the
k-th stretch of ids.  Each task encodes its documents and writes one Arrow IPC
file of the packed id stream: record batches of fixed-size lists (`ids`, `mask`;
equal-length sequences, the last one padded and masked), which a reader maps
and indexes without copying, and one file with the documents' places in it.
Files are written under the shared checkpoint folder with the task attempt in
their names; only the attempts that Spark commits are listed in the manifest,
so a lost executor or a speculative copy leaves no trace in the result.

Encoding: the byte-level pre-tokenizer's pattern is evaluated on whole batches
with numpy (character classes and run boundaries); the tokenizers library
encodes each distinct pre-token once per worker.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import application_key, ensure_checkpoint_dir
from . import textvec as tv
from .common import bounded_batches, stored
from .spancache import SpanCache

END_ID = 2
SEQUENCE = 2048          # ids in a sequence
GROUP = 256              # sequences in a record batch
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Class of every code point, by Unicode category and the White_Space rule."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


def code_points(data: np.ndarray):
    """Code point at every lead byte (0 elsewhere) and the mask of lead bytes."""
    lead = (data & 0xC0) != 0x80
    cp = data.astype(np.int32)
    wide = np.flatnonzero(lead & (data >= 0xC0))
    if len(wide):
        d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = (d[wide + k] for k in range(4))
        b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
        cp[wide] = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1,
                            np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    return cp, lead


def pretokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start offsets of the pre-tokens of the byte-level pattern
    ('s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ L N]+| space+(?!non-space)| space+)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cp, lead = code_points(data)
    kind = classes[cp]
    place = np.maximum.accumulate(np.where(lead, np.arange(n), 0))   # the lead byte of every byte
    kind = kind[place]
    full = off[:-1] < off[1:]
    doc_start = np.zeros(n + 1, bool)
    doc_start[off[:-1][full]] = True
    doc_start[n] = True
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut |= doc_start[:n]
    runs = np.flatnonzero(cut)
    ends = np.append(runs[1:], n)
    # white space before something else: its last character goes apart, a plain space with what follows
    s = (kind[runs] == SPACE) & ~doc_start[ends]
    s_end = ends[s]
    last = place[s_end - 1]
    cut[last] = True
    cut[s_end[data[last] == 32]] = False
    # contractions: a lone apostrophe that no space precedes, then the ending
    q = runs[(data[runs] == 39) & (ends - runs == 1)]
    q = q[cut[q] & ~doc_start[q + 1]]
    if len(q):
        d = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = d[q + 1], d[q + 2]
        same = ~doc_start[np.minimum(q + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ~short & same & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                                | ((one == ord("l")) & (two == ord("l"))))
        cut[q[short | long] + 1] = False
        stop = np.concatenate([q[short] + 2, q[long] + 3])
        cut[stop[stop < n]] = True
    return np.flatnonzero(cut)


def load(path: str):
    store = tv.process_store()
    if ("bpe", path) not in store:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True          # their strings in a text are ordinary text
        store["bpe", path] = tok, SpanCache(np.int32), _classes()
    return store["bpe", path]


def encode(data: np.ndarray, off: np.ndarray, path: str):
    """(ids, offsets) of the documents: what the library's encode gives for each text."""
    tok, cache, classes = load(path)
    starts = pretokens(data, off, classes)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    keys, first, inverse = np.unique(tv.span_hash(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()

    def make(index):
        texts = [raw[starts[k]:ends[k]].decode() for k in first[index]]
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    at, count = cache.fetch(keys, make)
    count = count[inverse]
    ids = tv.gather(cache.values, at[inverse], count)
    upto = np.concatenate([[0], np.cumsum(count)])
    return ids, upto[np.searchsorted(starts, off)]


def with_end(ids: np.ndarray, upto: np.ndarray, end_id: int):
    """Append end_id to every document."""
    n = len(upto) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(upto))] = ids
    return out, upto + np.arange(n + 1)


def open_store(uri: str):
    """(file system, path) of a folder named by URI or path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Packs an id stream into fixed-size-list batches of an Arrow IPC file."""

    def __init__(self, sink, dtype, length: int, group: int):
        self.length, self.group = length, group
        self.item = pa.from_numpy_dtype(dtype)
        self.dtype = dtype
        self.schema = pa.schema([("ids", pa.list_(self.item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.left = np.zeros(0, dtype)

    def _write(self, ids, valid):
        mask = np.arange(len(ids)) < valid
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def add(self, ids):
        ids = np.concatenate([self.left, ids.astype(self.dtype)])
        size = self.length * self.group
        whole = len(ids) // size * size
        for a in range(0, whole, size):
            self._write(ids[a:a + size], size)
        self.left = ids[whole:]

    def close(self):
        if len(self.left):
            pad = -len(self.left) % self.length
            self._write(np.concatenate([self.left, np.zeros(pad, self.dtype)]), len(self.left))
        self.out.close()


class SequenceReader:
    """Random access to the id stream of one file."""

    def __init__(self, source, length: int, group: int):
        self.file = pa.ipc.open_file(source)
        self.size = length * group
        self.held = (-1, None)

    def _batch(self, k):
        if self.held[0] != k:
            self.held = (k, self.file.get_batch(k).column(0).values.to_numpy())
        return self.held[1]

    def ids(self, start: int, count: int) -> np.ndarray:
        """ids[start:start+count]: a view if they lie in one batch."""
        if not count:
            return np.zeros(0, np.uint32)
        a, b = start // self.size, (start + count - 1) // self.size
        parts = [self._batch(k)[max(start - k * self.size, 0):start + count - k * self.size] for k in range(a, b + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, length: int = SEQUENCE,
              group: int = GROUP, text: str = "text") -> DataFrame:
    """Write the documents' ids, in ascending doc_id order (null first, ties by
    text), to Arrow files in `folder`; return the manifest: one row per file.

    One range shuffle of the texts; tasks stream, holding one slice of texts and
    one batch of ids.  An empty partition writes no file.  Ids are stored as
    unsigned 16-bit integers where the vocabulary allows, else 32-bit.
    """
    bounded_batches(docs.sparkSession)
    src = (docs.select("doc_id", F.col(f"`{text}`").alias("text"))
           .repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _, _ = load(tokenizer)
        dtype = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
        task = TaskContext.get()
        where, root = open_store(folder)
        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, docs_out, n_docs, n_ids = None, None, 0, 0
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for rows, data, off in tv.slices(batch, "text"):
                if writer is None:
                    where.create_dir(root, recursive=True)
                    ids_sink, docs_sink = where.open_output_stream(f"{path}.ids.arrow"), where.open_output_stream(f"{path}.docs.arrow")
                    writer, docs_out = SequenceWriter(ids_sink, dtype, length, group), pa.ipc.new_file(docs_sink, schema)
                ids, upto = with_end(*encode(data, off, tokenizer), end_id)
                writer.add(ids)
                docs_out.write_batch(pa.RecordBatch.from_arrays(
                    [rows.column(0).cast(pa.int64()), pa.array(upto[:-1] + n_ids), pa.array(np.diff(upto))], schema=schema))
                n_docs, n_ids = n_docs + len(off) - 1, n_ids + len(ids)
        if writer is not None:
            writer.close(), docs_out.close(), ids_sink.close(), docs_sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path],
                                              "n_docs": [n_docs], "n_ids": [n_ids]})

    return src.mapInArrow(run, MANIFEST)


def read_ids(manifest: DataFrame, folder: str, length: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit).

    One task per few files; the offset of a file is a running sum over the
    manifest, which has one short row per write task.
    """
    spark = manifest.sparkSession
    base = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(base), F.lit(0)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = open_store(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                local = type(where).__name__ == "LocalFileSystem"
                opened = pa.memory_map(f"{path}.ids.arrow") if local else where.open_input_file(f"{path}.ids.arrow")
                ids = SequenceReader(opened, length, group)
                with where.open_input_file(f"{path}.docs.arrow") as f:
                    table = pa.ipc.open_file(f).read_all()
                for docs in table.to_batches():
                    start, count = docs["start"].to_numpy(), docs["n_tokens"].to_numpy()
                    crc = [zlib.crc32(ids.ids(a, n).astype("<u4")) for a, n in zip(start.tolist(), count.tolist())]
                    yield pa.RecordBatch.from_arrays([docs["doc_id"], pa.array(start + base), docs["n_tokens"], pa.array(crc, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])
                opened.close()

    return (files.repartition(tasks, "part").select("path", "base")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def output_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/{name}/{application_key(spark)}-{uuid.uuid4().hex[:8]}"


def op4_token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = output_folder(docs.sparkSession, "token-files")
    return read_ids(stored(write_ids(docs, tokenizer, folder), "token-manifest"), folder)
