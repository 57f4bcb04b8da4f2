"""Centroid clustering (k-means on integer vectors) by a tournament of bisectors.

For centroids a < b the hyperplane half way between them decides which one is
nearer: |x-a|^2 <= |x-b|^2 holds exactly when 2x.(b-a) <= |b|^2 - |a|^2.
Normals 2(b-a) and thresholds |b|^2-|a|^2 of all pairs are made once per round;
a vector then plays a bracket of k-1 such sign tests, each of which eliminates
one centroid.  A difference of exactly zero favours the smaller number, which
stands on the left in every test of the bracket.  Only the distance to the
winner is computed as such.  All arithmetic is on integers: 64-bit where the
components leave room for it, Python's unbounded integers otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import bounded_batches, empty, stored

DIMENSION, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
LIMB = 32                                  # bits per part of a sum
LONG = (1 << 63) - 1
ROWS = 4096                                # rows per block of the bracket


def usable_vectors(vectors: DataFrame, id: str, embedding: str, dimension: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly `dimension` components, none null or non-finite."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) == dimension)).where(~bad)


def integers(column: pa.Array, dimension: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list<double> column: int64, or Python integers if any could overflow below."""
    with np.errstate(over="ignore"):
        x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension) * scale)
    if np.abs(x).max(initial=0) < room(dimension):
        return x.astype(np.int64)
    # doubles are dyadic: the exact product and its floor, whatever the size
    exact = [(n * scale) // d for n, d in (float(c).as_integer_ratio() for c in column.flatten().to_numpy(zero_copy_only=False))]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(-1, dimension)


def room(dimension: int) -> int:
    """Components under this bound keep every sum of the tests and distances inside 64 bits."""
    return int((2.0 ** 62 / (8 * dimension)) ** 0.5)


class Bracket:
    """Bisectors of all pairs of k centroids (lists of integers)."""

    def __init__(self, centroids: list[list[int]]):
        k, self.big = len(centroids), max((abs(c) for row in centroids for c in row), default=0) >= room(len(centroids[0]))
        self.points = np.array(centroids, dtype=object if self.big else np.int64)
        square = (self.points * self.points).sum(axis=1)
        self.normal = 2 * (self.points[None, :, :] - self.points[:, None, :])
        self.threshold = square[None, :] - square[:, None]
        self.k = k

    def nearest(self, x: np.ndarray):
        """(number of the nearest centroid, squared distance to it) of every row."""
        points, normal, threshold = self.points, self.normal, self.threshold
        if x.dtype == object and not self.big:
            points, normal, threshold = points.astype(object), normal.astype(object), threshold.astype(object)
        left = [np.full(len(x), c, np.int64) for c in range(self.k)]
        while len(left) > 1:
            after = []
            for a, b in zip(left[::2], left[1::2]):
                side = (x * normal[a, b]).sum(axis=1) - threshold[a, b]
                after.append(np.where((side > 0).astype(bool), b, a))
            left = after + ([left[-1]] if len(left) % 2 else [])
        gap = x - points[left[0]]
        return left[0], (gap * gap).sum(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), integers(part.column(1), dimension, scale)


def _limbs(values: list[int]) -> list[list[int]]:
    """Rows of 64-bit parts: value = sum of part j << (LIMB * j), the last part signed."""
    n = max(v.bit_length() for v in values) // LIMB + 1
    mask = (1 << LIMB) - 1
    return [[(v >> (LIMB * j)) & mask if j < n - 1 else v >> (LIMB * j) for v in values] for j in range(n)]


def _step(kept: DataFrame, centroids: list[list[int]], dimension: int, scale: int) -> list[list[int]]:
    """Centroids after one round: partial sums per task, added up by Spark in
    32-bit parts; at most k rows per part reach the driver."""
    def partial(batches):
        bracket, sums, counts = Bracket(centroids), {}, {}
        for _, x in _blocks(batches, dimension, scale):
            number, _ = bracket.nearest(x)
            for c in np.unique(number).tolist():
                rows = x[number == c]
                add = [int(s) for s in rows.sum(axis=0)]
                sums[c] = [a + b for a, b in zip(sums[c], add)] if c in sums else add
                counts[c] = counts.get(c, 0) + len(rows)
        found = [(c, j, counts[c] if j == 0 else 0, part) for c in sums for j, part in enumerate(_limbs(sums[c]))]
        if found:
            cols = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.list_(pa.int64()))], names=["cluster", "limb", "n", "parts"])

    rows = (kept.mapInArrow(partial, "cluster int, limb int, n long, parts array<long>").groupBy("cluster", "limb")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("parts")[i]) for i in range(dimension)]).alias("parts")).collect())
    count, total = {}, {}
    for r in rows:
        count[r["cluster"]] = count.get(r["cluster"], 0) + r["n"]
        so_far = total.get(r["cluster"], [0] * dimension)
        total[r["cluster"]] = [t + (p << (LIMB * r["limb"])) for t, p in zip(so_far, r["parts"])]
    return [[t // count[c] for t in total[c]] if c in total else centroids[c] for c in range(len(centroids))]


def first_centroids(kept: DataFrame, k: int, dimension: int, scale: int) -> list[list[int]]:
    """The k kept vectors with the smallest sha256 of "1:<vec_id>" (null ids
    last, rows of one id by their components): a top-k, not a collect."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    if not rows:
        return []
    return [[int(c) for c in row] for row in integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dimension, scale)]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id: str = "vec_id", embedding: str = "embedding",
            dimension: int = DIMENSION, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) per kept vector, the final centroids).

    Kept are vectors of exactly `dimension` components, none null or non-finite;
    others give no row.  Component x counts as floor(scale * x).  Repeated rows
    and rows of one id count one by one; a null id keeps its row.  Ties go to
    the smaller centroid, empty centroids stay as they are, fewer than k vectors
    give as many centroids, an empty table gives no rows.  Other columns are not
    read.  A squared distance beyond 64 bits is null.
    """
    bounded_batches(vectors.sparkSession)
    kept = usable_vectors(vectors, id, embedding, dimension)
    centroids = first_centroids(kept, k, dimension, scale)
    if not centroids:
        return empty(vectors.sparkSession, "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        centroids = _step(kept, centroids, dimension, scale)

    def assign(batches):
        bracket = Bracket(centroids)
        for ids, x in _blocks(batches, dimension, scale):
            number, distance = bracket.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)),
                                              pa.array([d if d <= LONG else None for d in distance.tolist()], pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def op13_clusters(vectors: DataFrame) -> DataFrame:
    """Clusters with inertias (null where a sum leaves 64 bits or a distance is null) and digests of the centroids."""
    found, centroids = cluster(vectors)
    spark = vectors.sparkSession
    found = stored(found, "clusters")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = found.groupBy("cluster").agg(total.alias("s")).collect()                    # at most k rows
    fits = lambda s: int(s) if s is not None and s <= LONG else None
    whole = None if any(r["s"] is None for r in per) else sum(int(r["s"]) for r in per)
    made = [Row(cluster=r["cluster"], cluster_inertia=fits(r["s"]), inertia=fits(whole),
                centroid_sha256=hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in per]
    facts = spark.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(facts), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _rounds_sql() -> str:
    """The rounds of the oracle: nearest by a minimum over (distance, number), then floored means."""
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"""near{r} as (
  select k.rid, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.c)) as best
  from kept k cross join cent{r} c group by k.rid)""")
        if r < ROUNDS:
            parts.append(f"""sums{r} as (
  select n.best.c as c, i, sum(k.v[i])::hugeint as s, count(*)::hugeint as n
  from near{r} n join kept k using (rid), range(1, {DIMENSION + 1}) t(i) group by n.best.c, i),
cent{r + 1} as (
  select c.c, coalesce(m.v, c.v) as v from cent{r} c left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from sums{r} group by c) m on m.c = c.c)""")
    return ",\n".join(parts)


OP13_SQL = f"""
with kept as (
  select row_number() over (order by vec_id, embedding) as rid, vec_id,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings
  where len(embedding) = {DIMENSION} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cent0 as (
  select (row_number() over (order by sha256('1:' || vec_id::varchar) nulls last, v) - 1)::int as c, v
  from kept qualify c < {CENTROIDS}),
{_rounds_sql()},
got as (select k.vec_id, n.best.c as cluster, n.best.d::bigint as distance from near{ROUNDS} n join kept k using (rid))
select vec_id, cluster::int as cluster, distance,
       sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
       sha256(array_to_string(c.v, ',')) as centroid_sha256
from got join cent{ROUNDS} c on c.c = got.cluster
"""
