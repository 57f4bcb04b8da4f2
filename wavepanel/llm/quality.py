"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a vector of transformed statistics of its whole text
(lengths, character classes, repetition of words, word pairs and lines, entropy,
the worst line).  Each class is a Gaussian whose covariance is shrunk towards a
diagonal; a score is the difference of the two log densities (Mahalanobis
distances through cached Cholesky factors), mapped to 0..1 by a logistic curve
fitted on a histogram of the training differences.

The fit needs sums only: counts, sums and cross products per class are added up
in the tasks and by Spark, so every labelled row takes part and the driver
receives about 600 numbers per class, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_batches, fresh, stored

SLICE = 512 << 10
SHRINK, RIDGE = 0.05, 1e-3
THRESHOLD = 0.3
BIN, BINS = 0.5, 400                     # histogram of log-density differences

UPPER, LOWER, DIGIT, MARK, SYMBOL, HIGH, BLANK, BREAK = range(8)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = UPPER, LOWER, DIGIT, HIGH
KIND[[ord(c) for c in ".,;:'\"()?-"]] = MARK
KIND[[9, 11, 12, 13, 32]] = BLANK
KIND[10] = BREAK


def _share(part, whole):
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _distinct(values: np.ndarray, owner: np.ndarray, docs: int):
    """(distinct values, largest multiplicity) per document."""
    if not len(values):
        return np.zeros(docs), np.zeros(docs)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(docs)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(v))))
    return np.bincount(o[first], minlength=docs).astype(float), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, features), transformed; an empty text has a vector too."""
    docs = len(off) - 1
    size = np.diff(off).astype(float)
    of_byte = np.repeat(np.arange(docs), np.diff(off))
    kind = KIND[data]
    table = np.bincount(of_byte * 8 + kind, minlength=docs * 8).reshape(docs, 8).astype(float)
    ink = size - table[:, BLANK] - table[:, BREAK]
    letters = table[:, UPPER] + table[:, LOWER] + table[:, HIGH]
    per_byte = np.bincount(of_byte * 256 + data, minlength=docs * 256).reshape(docs, 256)
    p = per_byte / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    s, e, upto = tv.words(data, off)
    n = np.diff(upto).astype(float)
    owner = np.repeat(np.arange(docs), np.diff(upto))
    length = (e - s).astype(float)
    total = lambda x: np.bincount(owner, x, minlength=docs)
    mean = _share(total(length), n)
    spread = np.sqrt(np.maximum(_share(total(length ** 2), n) - mean ** 2, 0))
    h = tv.span_hash(data, s, e)
    unique, most = _distinct(h, owner, docs)
    last, first = kind[e - 1], kind[s]
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    same = np.bincount(owner[follows[h[follows] == h[follows + 1]]], minlength=docs)
    pairs, _ = _distinct(tv.mix(h[follows] * np.uint64(3) + h[follows + 1]), owner[follows], docs)
    is_upper = np.concatenate([[0], np.cumsum(kind == UPPER)])
    is_lower = np.concatenate([[0], np.cumsum(kind == LOWER)])
    shout = ((is_lower[e] - is_lower[s]) == 0) & ((is_upper[e] - is_upper[s]) >= 2)

    a, z = tv.edges_of(data != 10, off)
    line_of = np.searchsorted(off, a, side="right") - 1
    lines = np.bincount(line_of, minlength=docs).astype(float)
    kept_lines, _ = _distinct(tv.span_hash(data, a, z), line_of, docs)
    first_word, after = np.searchsorted(s, a), np.searchsorted(s, z)
    words_in = after - first_word
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    worst = []
    for flag in (last == SYMBOL, shout, np.append(False, h[1:] == h[:-1])[:len(h)]):
        c = sums(flag)
        share = (c[after] - c[first_word]) / np.maximum(words_in, 8)
        top = np.zeros(docs)
        np.maximum.at(top, line_of, share)
        worst.append(top)

    small = lambda x: np.log(x + 0.005)  # noqa: E731  shares: what matters is often whether they are zero
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread),
        small(_share(table[:, UPPER], letters)), small(_share(table[:, DIGIT], ink)), small(_share(table[:, MARK], ink)),
        small(_share(table[:, SYMBOL], ink)), small(_share(table[:, HIGH], ink)), np.log1p(_share(size, lines)),
        _share(np.log1p(unique), np.log1p(n)), small(_share(most, n)), small(_share(same, n)),
        small(1 - _share(pairs, np.maximum(n - 1, 1))), small(_share(total(last == SYMBOL), n)), small(_share(total(first == UPPER), n)),
        small(_share(total(shout), n)), small(_share(total(length <= 3), n)), small(1 - _share(kept_lines, np.maximum(lines, 1))),
        entropy, small(worst[0]), small(worst[1]), small(worst[2]), small(_share(total(length >= 20), n)),
    ])


FEATURES = 23


def _with_text(docs: DataFrame, text: str, *cols) -> DataFrame:
    return docs.select(*cols, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, x): the vector of every document.  One narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in tv.slices(batch, "__text", SLICE):
                x = statistics(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "x"])

    return _with_text(docs, text, "doc_id").mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of the fit: crc32 of the id as text divisible by 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """Two Gaussians with cached Cholesky factors, and the logistic curve.  With
    rows of one class only (or none) every score is that class's (or 1)."""
    mean: np.ndarray
    factor: np.ndarray            # inverse Cholesky factors: y = factor @ (x - mean)
    log_det: np.ndarray
    log_prior: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    only: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x, label 1) - log p(x, label 0)."""
        part = [self.log_prior[c] - self.log_det[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) for c in (0, 1)]
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        d = np.clip(self.scale * self.difference(x) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-d))


def class_sums(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Per class the sum of the outer products of (1, x): tasks add up their rows, Spark the tasks'."""
    width = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, width))
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy().reshape(-1, FEATURES)
                x = np.column_stack([np.ones(len(x)), x])
                y = batch["quality"].to_numpy()
                for c in (0, 1):
                    total[c] += x[y == c].T @ x[y == c]
        cells = 2 * width * width
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    rows = labelled.select("x", "quality").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(2 * width * width)
    for r in rows:
        out[r["cell"]] = r["value"]
    return dict(enumerate(out.reshape(2, width, width)))


def gaussians(sums: dict[int, np.ndarray], shrink: float, ridge: float) -> Model:
    count = np.array([sums[c][0, 0] for c in (0, 1)])
    if not count.all():
        return Model(*[np.zeros(2)] * 4, only=1.0 if count[1] or not count.any() else 0.0)
    mean = np.array([sums[c][0, 1:] / count[c] for c in (0, 1)])
    cov = [sums[c][1:, 1:] / count[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = np.diag(sum(count[c] * cov[c] for c in (0, 1)) / count.sum())
    factor, log_det = [], []
    for c in (0, 1):
        own = shrink + FEATURES / (count[c] + FEATURES)           # few rows: more shrinkage
        own = min(own, 1.0)
        low = np.linalg.cholesky((1 - own) * cov[c] + own * np.diag(pooled) + ridge * np.eye(FEATURES))
        factor.append(np.linalg.inv(low))
        log_det.append(np.log(np.diag(low)).sum())
    return Model(mean, np.array(factor), np.array(log_det), np.log(count / count.sum()))


def calibrate(model: Model, labelled: DataFrame) -> Model:
    """Fit the logistic curve on a histogram of the differences (at most 2 * BINS rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = model.difference(batch["x"].flatten().to_numpy().reshape(-1, FEATURES))
                k = np.clip(np.floor(d / BIN), -BINS // 2, BINS // 2 - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k), batch["quality"]], names=["bin", "quality"])

    rows = labelled.select("x", "quality").mapInArrow(run, "bin int, quality int").groupBy("bin", "quality").count().collect()
    d = np.array([(r["bin"] + 0.5) * BIN for r in rows])
    y, n = np.array([r["quality"] for r in rows], float), np.array([r["count"] for r in rows], float)
    order = np.lexsort((y, d))
    d, y, n = d[order], y[order], n[order]
    a, b = 0.1, 0.0
    for _ in range(100):                                           # damped Newton steps with a small ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (y - p) * d).sum() - 1e-3 * a, (n * (y - p)).sum()])
        step = np.linalg.solve(np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-6]]), g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
    model.scale, model.shift = max(float(a), 1e-3), float(b)
    return model


def fit(vectors: DataFrame, labels: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """Learn from all labelled rows that are not held out.  Rows with a null id or
    a label other than 0 and 1 are left out; repeated labels count each time."""
    train = (vectors.join(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)"), "doc_id")
             .where(~held_out()).select("x", "quality"))
    train = stored(train, "quality-train")
    model = gaussians(class_sums(train), shrink, ridge)
    return model if model.only is not None else calibrate(model, train)


def predict(vectors: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from the documents' vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(batch["x"].flatten().to_numpy().reshape(-1, FEATURES))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], names=["doc_id", "score"])

    return vectors.mapInArrow(run, "doc_id long, score double")


def op8_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    A null text counts as empty; empty texts are scored like any other.  Labels,
    language, source and id are never inputs of a score.  Repeated rows are
    scored each; an empty table gives none; other columns are ignored.
    """
    vectors = stored(features(docs), "quality-vectors")
    out = predict(vectors, fit(vectors, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold; all columns, no shuffle of texts."""
    model = fit(features(docs, text), labels)
    bounded_batches(docs.sparkSession)
    cols, whole = docs.columns, fresh(docs, "whole_text")
    src = docs.withColumn(whole, F.coalesce(F.col(f"`{text}`"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in tv.slices(batch, whole, SLICE):
                yield rows.select(list(range(len(cols)))).filter(pa.array(model.score(statistics(data, off)) >= threshold))

    return src.mapInArrow(run, docs.schema)
