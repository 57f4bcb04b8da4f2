"""Scoring documents by masked pseudo-likelihood.

Every word is predicted from the two words on its left and the two on its right:
the words' embeddings (one table per place) are added, squashed and mapped to a
distribution over word classes; within a class a word has the share that the
corpus gives it.  A document's score is the sum over all its words of
log P(class | both sides) + log P(word | class).

Words are counted exactly, by a 64-bit key, in a table that grows with the
vocabulary.  Classes are equal shares of the text by falling frequency: a word
with at least 1 / HEAD of the text (there are at most HEAD) is placed by its own
count; rarer words, each under 1/4096 of a class, are dealt by their key over the
classes that follow.  Any word's share of its class is its own count over the
class's: the counts of rare words meet the documents by a key join.  Only as
inputs of the network are words hashed, into `buckets` embeddings.

The network is trained in numpy on every word of every document: each task runs
mini-batches over its own partition from the common start, and the results are
averaged, an embedding row by how often the task used it, the rest by words.
What is gathered (counts, and weights of each task) grows with the corpus; the
network has a fixed size, reaches the driver with the counts of the frequent
words, and goes to the scoring tasks by value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_batches, row_key, stored
from .pii import COUNT_LIMIT, ROWS, _Counts

BUCKETS, CLASSES, WIDTH = 8192, 64, 16
PLACES = (-2, -1, 1, 2)
BATCH, RATE = 16384, 0.15
HEAD, SLOTS = 1 << 18, 4096              # most words placed by their own count; slots of the others
CHUNK = 512                              # embedding rows in a piece of the model
SALTS = 1024                             # first-level groups when the tasks' weights are added


def keys_of(data: np.ndarray, off: np.ndarray):
    """(64-bit key of every word, offsets)."""
    s, e, upto = tv.words(data, off)
    return tv.span_hash(data, s, e), upto


def symbols(key: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Position in `heads` (sorted keys), or for a rarer word len(heads) + its slot."""
    rare = len(heads) + (key & np.uint64(SLOTS - 1)).astype(np.int64)
    if not len(heads):
        return rare
    at = np.minimum(np.searchsorted(heads, key), len(heads) - 1)
    return np.where(heads[at] == key, at, rare)


def windows(data: np.ndarray, off: np.ndarray, buckets: int, heads: np.ndarray):
    """(symbol of every word, (words, places) buckets around it with `buckets` where there is none, offsets)."""
    key, upto = keys_of(data, off)
    w = (key % np.uint64(buckets)).astype(np.int64)
    n = len(w)
    doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    around = np.full((n, len(PLACES)), buckets, np.int64)
    for k, p in enumerate(PLACES):
        at = np.arange(max(0, -p), n - max(0, p))
        at = at[doc[at] == doc[at + p]]
        around[at, k] = w[at + p]
    return symbols(key, heads), around, upto


@dataclass
class Model:
    """tables (places, buckets + 1, width): the last row stands for 'no word' and is zero."""
    tables: np.ndarray
    out: np.ndarray                      # (width + 1, classes), the last row a bias
    class_of: np.ndarray                 # class of every symbol
    log_share: np.ndarray                # log P(symbol | class); of a slot, what its words have besides log n
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))     # sorted keys of the frequent words

    def hidden(self, around):
        h = np.take(self.tables[0], around[:, 0], axis=0)
        for k in range(1, len(PLACES)):
            h += np.take(self.tables[k], around[:, k], axis=0)
        return np.tanh(h, out=h)

    def class_scores(self, h):
        z = h @ self.out[:-1]
        z += self.out[-1]
        z -= z.max(axis=1, keepdims=True)
        return z

    def word_scores(self, w, around) -> np.ndarray:
        """log P(word | both sides) of every word, for a rare one without log n."""
        out = np.empty(len(w))
        for a in range(0, len(w), BATCH):
            x, c = around[a:a + BATCH], self.class_of[w[a:a + BATCH]]
            z = self.class_scores(self.hidden(x))
            own = z[np.arange(len(c)), c]
            out[a:a + BATCH] = own - np.log(np.exp(z, out=z).sum(axis=1))
        return out + self.log_share[w]


def classes_of(counts: np.ndarray, classes: int, slots: int = 0):
    """Classes of equal share by falling count (ties by position; the last `slots`
    symbols after the others, as they stand), their counts, and the log shares within."""
    own = len(counts) - slots
    order = np.concatenate([np.argsort(-counts[:own], kind="stable"), np.arange(own, len(counts))])
    smooth = counts[order] + 1e-6
    middle = (np.cumsum(smooth) - smooth / 2) / smooth.sum()
    class_of = np.empty(len(counts), np.int64)
    # a very frequent word may fill several shares: only classes that hold a symbol are numbered
    class_of[order] = np.unique(np.minimum(middle * classes, classes - 1).astype(np.int64), return_inverse=True)[1]
    total = np.maximum(np.bincount(class_of, counts), 1)
    share = np.where(np.arange(len(counts)) < own, np.maximum(counts, 0.5), 1.0) / total[class_of]
    return class_of, total, np.log(share)


def start(counts: np.ndarray, classes: int, width: int, buckets: int = 0, heads: np.ndarray | None = None) -> Model:
    """The common start: small fixed random weights and the classes' own shares as bias.

    `counts` are of symbols: with `heads` of these words and of the slots after
    them.  Without `buckets` every symbol has an embedding of its own.
    """
    heads = np.zeros(0, np.uint64) if heads is None else heads
    class_of, share, log_share = classes_of(counts, classes, SLOTS if buckets else 0)
    rnd = np.random.default_rng(7)
    tables = rnd.normal(0, 0.05, (len(PLACES), (buckets or len(counts)) + 1, width)).astype(np.float32)
    tables[:, -1] = 0
    out = rnd.normal(0, 0.1, (width + 1, len(share))).astype(np.float32)
    out[-1] = np.log(share / share.sum())
    return Model(tables, out, class_of, log_share, heads)


class Trainer:
    """Mini-batch training of one task (Adagrad)."""

    def __init__(self, model: Model, rate: float):
        self.m = Model(model.tables.copy(), model.out.copy(), model.class_of, model.log_share, model.heads)
        self.rate = rate
        self.g_tables, self.g_out = np.full(self.m.tables.shape, 1e-8, np.float32), np.full(self.m.out.shape, 1e-8, np.float32)
        self.used = np.zeros(self.m.tables.shape[:2])
        self.words = 0

    def step(self, w, around):
        m, n = self.m, len(w)
        h = m.hidden(around)
        p = m.class_scores(h)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), m.class_of[w]] -= 1
        p /= n
        g = np.vstack([h.T @ p, p.sum(axis=0)])
        back = (p @ m.out[:-1].T) * (1 - h * h)
        self.g_out += g * g
        m.out -= self.rate * g / np.sqrt(self.g_out)
        rows, width = m.tables.shape[1:]
        back = back.T.astype(np.float64, order="C")
        for k in range(len(PLACES)):
            at = np.ascontiguousarray(around[:, k])
            g = np.empty((rows, width), np.float32)
            for c in range(width):                          # a column's sums fit the cache
                g[:, c] = np.bincount(at, back[c], rows)
            g[-1] = 0
            self.g_tables[k] += g * g
            m.tables[k] -= self.rate * g / np.sqrt(self.g_tables[k])
            self.used[k] += np.bincount(at, minlength=rows)
        self.words += n

    def run(self, w, around):
        for a in range(0, len(w), BATCH):
            self.step(w[a:a + BATCH], around[a:a + BATCH])


def _texts(docs: DataFrame, text: str, *cols) -> DataFrame:
    return docs.select(*cols, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """key, n: every word of all documents, counted exactly; a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()

        def rows():
            key, n = counts.take()
            for k in range(0, len(key), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(key[k:k + ROWS].view(np.int64)), pa.array(n[k:k + ROWS])], names=["key", "n"])

        for batch in batches:
            for _, data, off in tv.slices(batch, "__text"):
                counts.add(keys_of(data, off)[0])
                if counts.held > COUNT_LIMIT:
                    counts.merge()
                    if len(counts.keys) > COUNT_LIMIT:
                        yield from rows()
        yield from rows()

    bounded_batches(docs.sparkSession)
    return stored(_texts(docs, text).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")


def symbol_counts(words: DataFrame, head: int):
    """(sorted keys of the words with at least 1 / `head` of the text, counts of these and of the slots of all others)."""
    least = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) / head
    top = words.where(F.col("n") >= least).toArrow()
    key, n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(key)
    slots = np.zeros(SLOTS)
    for r in words.where(F.col("n") < least).groupBy(F.expr(f"key & {SLOTS - 1}L").alias("slot")).agg(F.sum("n").alias("n")).collect():
        slots[r["slot"]] = r["n"]
    return key[order], np.concatenate([n[order].astype(float), slots])


PIECE = "piece int, task int, value binary, weight binary"


def _added(t: pa.Table) -> pa.Table:
    """Weighted sums of one piece, in the order of the tasks."""
    t = t.sort_by("task")
    value = sum(np.frombuffer(v.as_py(), np.float64) for v in t["value"])
    weight = sum(np.frombuffer(v.as_py(), np.float64) for v in t["weight"])
    return pa.table({"piece": t["piece"][:1], "task": t["task"][:1], "value": [value.tobytes()], "weight": [weight.tobytes()]})


def train(docs: DataFrame, buckets: int = BUCKETS, classes: int = CLASSES, width: int = WIDTH, rate: float = RATE,
          text: str = "text", head: int = HEAD) -> tuple[Model, DataFrame]:
    """One pass of training over all documents from the corpus's counts: the network, and the counts of all words."""
    words = word_counts(docs, text)
    heads, counts = symbol_counts(words, head)
    common = start(counts, classes, width, buckets, heads)
    pieces = -(-(buckets + 1) // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held = Trainer(common, rate), []
        for batch in batches:
            for _, data, off in tv.slices(batch, "__text"):
                w, around, _ = windows(data, off, buckets, common.heads)
                t.run(w, around)
        if not t.words:
            return
        task = TaskContext.get().partitionId()
        for k in range(len(PLACES)):
            for c in range(pieces):
                rows = slice(c * CHUNK, (c + 1) * CHUNK)
                used = t.used[k, rows]
                value = (t.m.tables[k, rows].astype(np.float64) - common.tables[k, rows]) * used[:, None]
                held.append((k * pieces + c, task, value.tobytes(), used.tobytes()))
        held.append((-1, task, ((t.m.out.astype(np.float64) - common.out) * t.words).tobytes(), np.array([t.words], float).tobytes()))
        cols = list(zip(*held))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
                                          pa.array(cols[3], pa.binary())], names=["piece", "task", "value", "weight"])

    parts = _texts(docs, text).mapInArrow(run, PIECE)
    some = parts.groupBy("piece", F.pmod("task", F.lit(SALTS))).applyInArrow(_added, PIECE)
    rows = some.groupBy("piece").applyInArrow(_added, PIECE).collect()
    for r in rows:
        value, weight = np.frombuffer(r["value"], np.float64), np.frombuffer(r["weight"], np.float64)
        if r["piece"] < 0:
            common.out += (value / weight[0]).reshape(common.out.shape).astype(np.float32)
        else:
            k, c = divmod(r["piece"], pieces)
            move = np.divide(value.reshape(len(weight), -1), weight[:, None], out=np.zeros((len(weight), width)), where=weight[:, None] > 0)
            common.tables[k, c * CHUNK:(c + 1) * CHUNK] += move.astype(np.float32)
    common.tables[:, -1] = 0
    return common, words


def rare_words(batches: Iterator[pa.RecordBatch], heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    """rid, key, times: the words of every document that are not in `heads`."""
    for batch in batches:
        for rows, data, off in tv.slices(batch, "__text"):
            key, upto = keys_of(data, off)
            rare = symbols(key, heads) >= len(heads)
            doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))[rare]
            key = key[rare]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(doc)))
            for k in range(0, len(first), ROWS):
                at = first[k:k + ROWS]
                yield pa.RecordBatch.from_arrays([rows.column("rid").take(pa.array(doc[at])), pa.array(key[at].view(np.int64)),
                                                  pa.array(times[k:k + ROWS].astype(np.int32))], names=["rid", "key", "times"])


def score(docs: DataFrame, trained: tuple[Model, DataFrame], text: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum over all words), mean_log_prob (null without words).

    A word that the training corpus does not hold counts as half a word of its slot's class.
    """
    bounded_batches(docs.sparkSession)
    model, words = trained
    buckets = model.tables.shape[1] - 1
    src = _texts(docs, text, "doc_id", row_key(text=text).alias("rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in tv.slices(batch, "__text"):
                w, around, upto = windows(data, off, buckets, model.heads)
                sums = np.concatenate([[0.0], np.cumsum(model.word_scores(w, around))])
                yield pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("doc_id"), pa.array(np.diff(upto).astype(np.int64)),
                                                  pa.array(sums[upto[1:]] - sums[upto[:-1]])], names=["rid", "doc_id", "n_words", "known"])

    # log n of the rare words; a word that occurs once has none to add
    heads = model.heads
    rare = src.select("rid", "__text").mapInArrow(lambda it: rare_words(it, heads), "rid long, key long, times int")
    log_n = (rare.join(words, "key", "left").where(F.col("n").isNull() | (F.col("n") > 1))
             .groupBy("rid").agg(F.sum(F.col("times") * F.log(F.coalesce(F.col("n").cast("double"), F.lit(0.5)))).alias("log_n")))
    known = src.mapInArrow(run, "rid long, doc_id long, n_words long, known double")
    # repeated rows share a key: each adds the same to the sum
    both = (known.select("rid", "doc_id", "n_words", "known", F.lit(0.0).alias("log_n"), F.lit(1).alias("copies"))
            .unionByName(log_n.withColumn("copies", F.lit(0)), allowMissingColumns=True)
            .groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"),
                                (F.max("known") + F.sum("log_n") / F.sum("copies")).alias("log_prob")))
    return (both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob")))


def op5_masked_lm(docs: DataFrame) -> DataFrame:
    """Train on all documents and score each.  A null text counts as empty and
    scores 0 over 0 words; repeated rows count and are scored each; other columns
    are ignored; an empty table gives no rows."""
    return score(docs, train(docs))
