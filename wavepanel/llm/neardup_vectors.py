"""Near-duplicate embeddings: PCA-ordered tiled comparison.

Vectors are normalised and rotated onto the principal axes of the whole table
(second moments summed by Spark over all rows), which changes no inner product.
The leading axes hold most of every product, and by Cauchy-Schwarz the rest is
at most the product of the norms of the two rests: with that norm as one more
coordinate, one matrix product in single precision bounds all products of a tile
pair from above.  Pairs whose bound, less its rounding error, reaches the
threshold are decided by the cosine of the original vectors in double precision.

Equal vectors are one representative with a multiplicity, so a group of copies
costs one row; rows find their representative again by a hash of the vector that
is checked to be unique among the representatives.  Representatives are dealt
into cells by the signs of the leading coordinates and cells into tiles of
bounded size (a crowded cell has several), which are stored once.  All pairs of
tiles are met by tasks that read two parts of the stored tiles each (no shuffle:
the tiles' one copy is all that lies on disk); tile pairs whose bounding boxes on
the leading axes lie too far apart are dropped, the others compared with two
tiles in memory.  A task returns per vector a link count and one label of its
local component, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, stored
from .vectors import dimension, matrix, settings, small_batches, sound

THRESHOLD, TILE, LEAD = 0.9, 2048, 8
PART_BYTES, CACHE_BYTES = 32 << 20, 64 << 20     # of tiles that a task reads from either side; of what a worker keeps made ready
HELD = 1 << 18                                   # link counts that a task holds before it adds them up
BLOCK = 512                                      # rows of a tile whose products with another tile are looked at together

def second_moments(rows: DataFrame) -> np.ndarray:
    """Mean of x x^T over the normalised vectors: tasks add, Spark sums, d * d numbers return."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["v"]).astype(np.float64)
                x = x / np.linalg.norm(x, axis=1)[:, None]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    got = rows.select("v").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["cell"]] = r["value"]
    d = int(round(len(got) ** 0.5))
    return out.reshape(d, d)


def principal_axes(moments: np.ndarray) -> np.ndarray:
    """Columns by falling share of the squared length; signs fixed."""
    values, axes = np.linalg.eigh((moments + moments.T) / 2)
    axes = axes[:, np.argsort(-values, kind="stable")]
    return axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(axes))] < 0, -1.0, 1.0)


def leading(moments: np.ndarray, threshold: float) -> int:
    """How many axes to look at first: so many that two vectors whose products on
    them are as those of unrelated ones come four deviations short of the threshold."""
    share = np.maximum(np.sort(np.linalg.eigvalsh((moments + moments.T) / 2))[::-1], 0.0)
    share = share / share.sum()
    d = len(share)
    for k in range(8, d, 8):
        if threshold - (1.0 - share[:k].sum()) >= 4.0 * np.sqrt((share[:k] ** 2).sum()):
            return k
    return d


def made_ready(x: np.ndarray, axes: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows, and their leading coordinates with the norm of the rest."""
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    lead = (x / norm[:, None]) @ axes[:, :cut]
    if cut < len(axes):
        rest = np.sqrt(np.maximum(1.0 - (lead ** 2).sum(axis=1), 0.0) + 1e-12)
        lead = np.column_stack([lead, rest])
    return norm, lead.astype(np.float32)


def linked_pairs(a: np.ndarray, b: np.ndarray, ready_a, ready_b, threshold: float, same: bool):
    """Index pairs (i, j) with cosine >= threshold between the rows of a and b (i < j if they are one tile)."""
    (na, la), (nb, lb) = ready_a, ready_b
    low = threshold - 1e-9 - (la.shape[1] + 8) * 2.0 ** -23      # rounding: of the coordinates, and of each sum
    whole = None
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(a), BLOCK):
        first = s if same else 0                                 # of one tile, only what lies right of the diagonal
        i, j = np.divmod(np.flatnonzero(la[s:s + BLOCK] @ lb[first:].T >= low), len(b) - first)
        i, j = i + s, j + first
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i) * 64 > BLOCK * len(b):                         # a dense part: all cosines at once, only close calls one by one
            if whole is None:
                whole = [x.astype(np.float64) / n[:, None] for x, n in ((a, na), (b, nb))]
            g = (whole[0][s:s + BLOCK] @ whole[1].T)[i - s, j]
            sure = g >= threshold + 1e-9
            close = np.flatnonzero(~sure & (g >= threshold - 1e-9))
        else:
            sure, close = np.zeros(len(i), bool), np.arange(len(i))
        for k in range(0, len(close), 1 << 16):                  # in blocks: memory stays bounded
            at = close[k:k + (1 << 16)]
            x, y = i[at], j[at]
            sure[at] = np.einsum("nd,nd->n", a[x].astype(np.float64), b[y].astype(np.float64)) / (na[x] * nb[y]) >= threshold
        out_i.append(i[sure]), out_j.append(j[sure])
    return np.concatenate(out_i), np.concatenate(out_j)


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, by minimum propagation with pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def as_binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x.tobytes())])


def pack(rows: DataFrame, axes: np.ndarray, tile: int, lead: int, kind: str) -> tuple[DataFrame, int]:
    """(tile, low, high, ids, copies, data): tiles of representatives with their
    bounding boxes, and the number of parts they are stored in."""
    n = rows.count()
    lead = min(lead, len(axes))
    bits = min(lead, max(0, int(np.ceil(np.log2(max(n, 1) / tile)))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch["v"])
                x = v.astype(np.float64)
                sign = ((x / np.linalg.norm(x, axis=1)[:, None]) @ axes[:, :bits]) > 0 if bits else np.zeros((len(x), 0), bool)
                cell = (sign * (1 << np.arange(bits))).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["copies"], as_binary(v), pa.array(cell)], names=["id", "copies", "v", "cell"])

    placed = rows.select("id", "copies", "v").mapInArrow(cells, "id long, copies long, v binary, cell long")
    split = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("long").alias("parts"))
    number = stored(split.selectExpr("cell", "parts", "sum(parts) over (order by cell rows between unbounded preceding and 1 preceding) as base"), "vector-tiles-of-cells")
    dealt = placed.join(number, "cell").withColumn("tile", F.coalesce("base", F.lit(0)) + F.pmod(F.xxhash64("id"), F.col("parts")))

    def packed(t: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(t["v"].to_pylist()), kind).reshape(t.num_rows, -1)
        x = v.astype(np.float64)
        box = (x / np.linalg.norm(x, axis=1)[:, None]) @ axes[:, :lead]
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        return pa.table({"tile": pa.array([t["tile"][0].as_py()], pa.int64()), "low": pa.array([box.min(axis=0).tolist()]),
                         "high": pa.array([box.max(axis=0).tolist()]), "ids": [t["id"].to_numpy()[order].tobytes()],
                         "copies": [t["copies"].to_numpy()[order].tobytes()], "data": [v[order].tobytes()]})

    tiles = number.agg(F.sum("parts")).first()[0]
    parts = int(min(tiles, max(16, -(-n * len(axes) * np.dtype(kind).itemsize // PART_BYTES))))
    return (dealt.select("tile", "id", "copies", "v").repartition(parts, "tile").groupBy("tile")
            .applyInArrow(packed, "tile long, low array<double>, high array<double>, ids binary, copies binary, data binary")), parts


def summed_links(ids: np.ndarray, many: np.ndarray, label: np.ndarray):
    """One row per id: its links, and the smallest id that the labels join it with."""
    known, at = np.unique(ids, return_inverse=True)
    return known, np.bincount(at, many).astype(np.int64), known[local_labels(len(known), at, np.searchsorted(known, label))]


def compare(axes: np.ndarray, cut: int, threshold: float, kind: str):
    """For mapInArrow over pairs of tiles: (id, links, label), an id at most once in so many pairs as a task can hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, room, held, size = {}, CACHE_BYTES, [], 0

        def batch_of(parts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["id", "links", "label"])

        for batch in batches:
            for k in range(batch.num_rows):
                tile, other = batch["tile"][k].as_py(), batch["other"][k].as_py()
                ids, copies, ids2, copies2 = (np.frombuffer(batch[c][k].as_buffer(), np.int64) for c in ("ids", "copies", "ids2", "copies2"))
                a, b = (np.frombuffer(batch[c][k].as_buffer(), kind).reshape(len(x), -1) for c, x in (("data", ids), ("data2", ids2)))
                got = []
                for t, x in ((tile, a), (other, b)):
                    made = ready.get(t) or made_ready(x, axes, cut)
                    if t not in ready and room > 0:
                        ready[t], room = made, room - sum(m.nbytes for m in made)
                    got.append(made)
                i, j = linked_pairs(a, b, *got, threshold, tile == other)
                if not len(i):
                    continue
                if tile != other:
                    j, ids, copies = j + len(ids), np.append(ids, ids2), np.append(copies, copies2)
                many = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                label = local_labels(len(ids), i, j)
                hit = np.flatnonzero(many)
                held.append((ids[hit], many[hit], ids[label[hit]]))
                size += len(hit)
                if size > HELD:
                    held = [summed_links(*(np.concatenate(c) for c in zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield batch_of(held[0])
                        held, size = [], 0
        if held:
            yield batch_of(summed_links(*(np.concatenate(c) for c in zip(*held))))

    return run


def vector_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("v").cast("array<double>"))


def unique_seed(classes: DataFrame) -> int:
    """The first seed with which no two of the vectors share a key."""
    return next(s for s in count() if classes.groupBy(vector_key(s).alias("key")).count().where("count > 1").isEmpty())


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, lead: int = LEAD,
                    id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, hold null or non-finite components, or differ
    from the table's dimension link with nothing and are components of their
    own.  Equal vectors link with each other.  A null vec_id is never a
    component's id unless all its ids are null.  Other columns are ignored; an
    empty table gives no rows.
    """
    # the shuffle files of a stored table go once it is written, not when the driver happens to collect its garbage
    with settings(vectors.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        every, known = linked(vectors, threshold, tile, lead, id, embedding)
    out = every.join(known.select("key", "links", "component_id"), "key", "left")
    return (out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                       F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def linked(vectors: DataFrame, threshold: float, tile: int, lead: int, id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, key), the key null where the vector takes no part; and of each key links and component_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{embedding}`").alias("v"))
    kind = "float32" if isinstance(getattr(rows.schema["v"].dataType, "elementType", None), FloatType) else "float64"
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    takes_part = sound(F.col("v"))
    takes_part = takes_part & (F.size("v") == dimension(rows.where(takes_part)))
    # single precision is kept as such: half the bytes, the same numbers
    groups = rows.where(takes_part).withColumn("v", F.col("v").cast("array<float>" if kind == "float32" else "array<double>")).groupBy("v")
    classes = stored(groups.agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("copies"))
                     .select(F.monotonically_increasing_id().alias("node"), "smallest", "copies", "v"), "vector-classes")
    # a class is known by its smallest id where that is unique (ids are), else by its number
    classes = classes.select(F.coalesce("smallest", -1 - F.col("node")).alias("id"), "smallest", "copies", "v")
    key = vector_key(unique_seed(classes))
    if classes.isEmpty():
        links = spark.createDataFrame([], "id long, links long, label long")
    else:
        moments = second_moments(classes)
        axes = principal_axes(moments)
        tiles, stored_parts = pack(classes, axes, tile, lead, kind)
        tiles = stored(tiles, "vector-tiles")
        far = 2.0 * (1.0 - threshold) + 1e-9
        other = tiles.select(F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("ids").alias("ids2"),
                             F.col("copies").alias("copies2"), F.col("data").alias("data2"))
        gaps = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y),
                          lambda p, q: F.pow(F.greatest(p, q, F.lit(0.0)), F.lit(2.0)))
        near = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) <= far
        # a product of the stored parts: its tasks read them where they lie, nothing is shuffled
        work = tiles.coalesce(stored_parts).hint("shuffle_replicate_nl").join(other.coalesce(stored_parts), (F.col("tile") <= F.col("other")) & near)
        with small_batches(spark, 2), settings(spark, {"spark.sql.files.maxPartitionBytes": PART_BYTES * 3 // 2}):
            links = stored(work.select("tile", "other", "ids", "copies", "data", "ids2", "copies2", "data2")
                           .mapInArrow(compare(axes, leading(moments, threshold), threshold, kind), "id long, links long, label long"), "vector-links")
    parts = components(links.select("id", "label"), "id", "label", "vector-cc")
    many = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = (classes.select("id", "smallest", "copies", key.alias("key")).join(many, "id", "left")
             .join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
             .select("key", "component", "smallest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    least = known.groupBy("component").agg(F.min("smallest").alias("component_id"))
    return rows.select(F.col("id").alias("vec_id"), F.when(takes_part, key).alias("key")), known.join(least, "component")


def op7_vectors(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
