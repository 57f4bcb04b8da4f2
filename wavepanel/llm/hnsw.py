"""Nearest neighbours by a navigable small-world graph per shard.

Rows are dealt into shards of bounded size by a hash of their id, and each shard
is indexed in one task.  Equal vectors are one node with a list of ids.  A node's
level is geometric in a hash of its vector; every level links each of its nodes
to diverse near nodes (a candidate is taken if it is nearer to the node than to
every neighbour taken before; then the nearest fill up), and links run both ways.
A level's links are one flat array of node numbers with a fixed number of places
per node.  Parts of a level that no link joins (tight groups larger than a node's
links) are joined by their nearest outside nodes.  Largest inner product is turned
into nearness by the usual extra coordinate sqrt(M^2 - |x|^2) when the graph is built.

A search descends from the few nodes of the top level and runs a best-first beam
on each level; all queries of a block advance together, one numpy step at a time.
The nodes of the last beam are scored on the original vectors in double precision.
How wide the beam has to be depends on the data: each shard measures it when it is
built, on SAMPLE of its own rows against an exact scan, and keeps the narrowest of
WIDTHS that finds TARGET of the true neighbours; a shard where none does is scanned.
Shard results are merged by score.  Query blocks meet every shard: each block is
copied once per shard and joined by shard number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .common import stored
from .vectors import matrix, small_batches, usable

K, SHARD, BLOCK = 20, 8192, 512
DEGREE, CANDIDATES, TOP_WIDTH, AT_ONCE, JOINS = 16, 48, 16, 4, 4
WIDTHS, SAMPLE, TARGET = (32, 48, 72, 108, 162, 243, 364, 546, 819, 1228), 64, 0.985


def link(x: np.ndarray, degree: int, candidates: int) -> np.ndarray:
    """Neighbours (n, 2 * degree) among the rows of x (squared distance), -1 where none."""
    n = len(x)
    places = 2 * degree
    out = np.full((n, places), -1, np.int32)
    c = min(candidates, n - 1)
    if c < 1:
        return out
    square = (x ** 2).sum(1)
    src, dst, dist = [], [], []
    for a in range(0, n, 512):
        b = min(a + 512, n)
        d = np.maximum(square[a:b, None] + square[None] - 2 * x[a:b] @ x.T, 0)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        near = np.argpartition(d, c - 1, axis=1)[:, :c]
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        d = np.take_along_axis(d, near, 1)
        y = x[near]
        between = square[near][:, :, None] + square[near][:, None] - 2 * y @ y.transpose(0, 2, 1)
        taken = np.zeros((b - a, c), bool)
        for k in range(c):
            clash = (taken[:, :k] & (between[:, k, :k] <= d[:, k, None])).any(axis=1)
            taken[:, k] = ~clash & (taken.sum(axis=1) < degree)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :degree]        # the diverse ones, then the nearest
        src.append(np.repeat(np.arange(a, b), rank.shape[1]))
        dst.append(np.take_along_axis(near, rank, 1).ravel())
        dist.append(np.where(np.take_along_axis(taken, rank, 1), -1.0, 0.0).ravel() + 0 * np.take_along_axis(d, rank, 1).ravel())
    src, dst, first = np.concatenate(src), np.concatenate(dst), np.concatenate(dist)
    # own links come first, diverse before filling; links back take the places left, the nearest first
    gap = np.maximum(square[src] + square[dst] - 2 * (x[src] * x[dst]).sum(1), 0)
    s, t = np.append(src, dst), np.append(dst, src)
    group = np.append(first, np.ones(len(src)))
    order = np.lexsort((np.append(gap, gap), group, s))
    s, t = s[order], t[order]
    key = s.astype(np.int64) * n + t
    _, keep = np.unique(key, return_index=True)
    keep.sort()
    s, t = s[keep], t[keep]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    ok = place < places
    out[s[ok], place[ok]] = t[ok]
    return out


def parts(links: np.ndarray) -> np.ndarray:
    """A label per node, equal for nodes that links join (in either direction)."""
    label = np.arange(len(links))
    src, slot = np.nonzero(links >= 0)
    dst = links[src, slot]
    while True:
        low = label.copy()
        np.minimum.at(low, src, label[dst])
        np.minimum.at(low, dst, label[src])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def join_parts(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """`links` with JOINS more places per node, filled so that the graph hangs together:
    each part but the largest is linked, both ways, from some of its nodes to the
    nearest nodes outside it that have a place left."""
    square = (x ** 2).sum(1)
    links = np.column_stack([links, np.full((len(links), JOINS), -1, np.int32)])
    while True:
        label = parts(links)
        names, count = np.unique(label, return_counts=True)
        if len(names) == 1:
            return links
        free = links.shape[1] - (links >= 0).sum(1)
        for c in names[np.argsort(count, kind="stable")][:-1]:
            inside = np.flatnonzero(label == c)
            some = inside[np.linspace(0, len(inside) - 1, min(len(inside), 3)).astype(int)]
            gap = square[None] - 2 * x[some] @ x.T
            gap[:, inside] = np.inf
            gap[:, free <= 0] = np.inf
            for i, node in enumerate(some):
                other = int(gap[i].argmin())
                if np.isfinite(gap[i, other]) and free[node] > 0 and free[other] > 0:
                    for u, v in ((node, other), (other, node)):
                        links[u, np.flatnonzero(links[u] < 0)[0]] = v
                        free[u] -= 1
        if len(np.unique(parts(links))) == len(names):     # no place was left where one was needed: more of them
            links = np.column_stack([links, np.full((len(links), JOINS), -1, np.int32)])


def build(ids: np.ndarray, x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, k: int = K) -> dict:
    """The index of a shard as flat arrays: distinct vectors, their ids, per level
    nodes and links, and the width of the beam (0: scan)."""
    nodes, at = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, at.ravel()))
    count = np.bincount(at.ravel(), minlength=len(nodes))
    bits = tv.mix((np.ascontiguousarray(nodes).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64)
                  + np.arange(len(nodes), dtype=np.uint64))
    level = np.floor(-np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / np.log(degree)).astype(int)
    norms = (nodes ** 2).sum(1)
    wide = np.column_stack([nodes, np.sqrt(np.maximum(norms.max() - norms, 0))])
    members, links = [], []
    for j in range(int(level.max()) + 1):
        m = np.flatnonzero(level >= j).astype(np.int32)
        near = join_parts(wide[m], link(wide[m], degree, candidates))
        members.append(m)
        links.append(np.where(near >= 0, m[near], -1).astype(np.int32))
    index = {"ids": ids[order], "count": count.astype(np.int64), "nodes": nodes, "members": members, "links": links}
    return index | {"width": narrowest(index, nodes[np.argsort(bits)[:SAMPLE]], k)}


def narrowest(index: dict, q: np.ndarray, k: int) -> int:
    """The narrowest beam that finds TARGET of the sample's k + 1 best nodes; 0 if none does."""
    nodes = index["nodes"]
    best = q @ nodes.T
    n = min(k + 1, len(nodes))
    worst = np.partition(best, len(nodes) - n, axis=1)[:, len(nodes) - n]
    for width in WIDTHS:
        if width < n:
            continue
        if width >= len(nodes):
            break
        found = descend(index, q, width)
        value = np.where(found >= 0, np.take_along_axis(best, np.maximum(found, 0), 1), -np.inf)
        if np.minimum((value >= worst[:, None]).sum(1), n).mean() >= TARGET * n:
            return width
    return 0


def beam(q: np.ndarray, nodes: np.ndarray, links: np.ndarray, row: np.ndarray, start: np.ndarray, width: int, at_once: int) -> np.ndarray:
    """Best-first search of one level for all queries: (queries, width) node numbers, -1 where fewer.

    links: neighbours by row; row: the row of every node of the level; start: (queries, s) nodes."""
    n_q = len(q)
    seen = np.zeros((n_q, len(nodes) + 1), bool)                 # the last column takes the missing places
    score = lambda who, ids: np.where(ids >= 0, (nodes[ids] @ q[who][:, :, None])[:, :, 0], -np.inf)
    everyone = np.arange(n_q)
    held = np.full((n_q, width), -1, np.int64)
    held[:, :start.shape[1]] = start[:, :width]
    seen[everyone[:, None], held] = True
    value = score(everyone, held)
    done = held < 0
    active = everyone
    while len(active):
        open_value = np.where(done[active], -np.inf, value[active])
        pick = np.argpartition(-open_value, min(at_once, width) - 1, axis=1)[:, :at_once]
        ok = np.take_along_axis(open_value, pick, 1) > -np.inf
        go = ok.any(axis=1)
        active, pick, ok = active[go], pick[go], ok[go]
        if not len(active):
            break
        done[active[:, None], pick] = True
        chosen = np.take_along_axis(held[active], pick, 1)
        near = np.where(ok[:, :, None], links[row[chosen]], -1).reshape(len(active), -1)
        near = np.where(seen[active[:, None], near], -1, near)
        near = np.sort(near, axis=1)                             # a node that two picks share counts once
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[active[:, None], near] = True
        fresh = score(active, near)
        ids = np.concatenate([held[active], near], axis=1)
        values = np.concatenate([value[active], fresh], axis=1)
        flags = np.concatenate([done[active], near < 0], axis=1)
        best = np.argpartition(-values, width - 1, axis=1)[:, :width]
        held[active], value[active], done[active] = (np.take_along_axis(v, best, 1) for v in (ids, values, flags))
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(held, order, 1)


def descend(index: dict, q: np.ndarray, width: int) -> np.ndarray:
    """(queries, width) nodes of the last beam, -1 where fewer.  The way down is
    taken in single precision."""
    nodes, q = index["nodes"].astype(np.float32), q.astype(np.float32)
    found = None
    for level in range(len(index["members"]) - 1, -1, -1):
        members = index["members"][level]
        row = np.zeros(len(nodes), np.int64)
        row[members] = np.arange(len(members))
        if found is None:
            found = np.repeat(members[None, :TOP_WIDTH].astype(np.int64), len(q), axis=0)
        found = beam(q, nodes, index["links"][level], row, found, width if level == 0 else TOP_WIDTH, AT_ONCE)
    return found


def search(index: dict, own: np.ndarray, q: np.ndarray, k: int):
    """Per query the k best ids of the shard other than its own: (query id, id, score)."""
    nodes = index["nodes"]
    if index["width"]:
        found = descend(index, q, index["width"])
    else:                                                        # no beam was good enough: the k + 1 best of all nodes
        n = min(k + 1, len(nodes))
        found = np.concatenate([np.argpartition(-(q[a:a + 64] @ nodes.T), n - 1, axis=1)[:, :n] for a in range(0, len(q), 64)])
    first = np.cumsum(index["count"]) - index["count"]
    out = []
    for i in range(len(q)):
        f = found[i][found[i] >= 0]
        s = nodes[f] @ q[i]
        take = np.minimum(index["count"][f], k + 1)             # of equal vectors only the smallest ids can be wanted
        ids = tv.gather(index["ids"], first[f], take)
        s = np.repeat(s, take)
        other = ids != own[i]
        ids, s = ids[other], s[other]
        best = np.lexsort((ids, -s))[:k]
        out.append((np.full(len(best), own[i]), ids[best], s[best]))
    return [np.concatenate(v) for v in zip(*out)]


INDEX = "shard long, width int, ids binary, count binary, nodes binary, members array<binary>, links array<binary>"


def index_shards(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard: its graph as flat arrays.  Every row of the table is indexed."""
    shards = max(1, -(-rows.count() // shard))

    def made(t: pa.Table) -> pa.Table:
        index = build(t["id"].to_numpy(), matrix(t["v"]))
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int64()), "width": pa.array([index["width"]], pa.int32()),
                         "ids": [index["ids"].astype(np.int64).tobytes()],
                         "count": [index["count"].tobytes()], "nodes": [index["nodes"].tobytes()],
                         "members": pa.array([[m.tobytes() for m in index["members"]]], pa.list_(pa.binary())),
                         "links": pa.array([[m.tobytes() for m in index["links"]]], pa.list_(pa.binary()))})

    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInArrow(made, INDEX)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK,
            id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` the k rows
    of `vectors` with the largest inner product found, the query's own id apart.

    Ties go to the smaller id.  Vectors that are null, zero, hold null or
    non-finite components, have a null id or differ from the table's dimension
    take no part on either side.  Repeated rows (equal id and vector) are
    indexed each; other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.where(F.col(f"`{id}`").isNotNull()), id, embedding)
    asked = usable(queries.where(F.col(f"`{id}`").isNotNull()), id, embedding)
    index = stored(index_shards(rows, shard), "hnsw-index")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-asked.count() // block))

    def packed(t: pa.Table) -> pa.Table:
        return pa.table({"own": [t["id"].to_numpy().tobytes()], "asked": [matrix(t["v"]).tobytes()]})

    asked = (asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).groupBy("block")
             .applyInArrow(packed, "own binary, asked binary"))
    work = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).join(index, "shard")
    work = work.repartition(int(max(1, min(blocks * shards, 10_000))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch[c][i].as_py() for c in batch.schema.names}
                count = np.frombuffer(r["count"], np.int64)
                links = [np.frombuffer(b, np.int32) for b in r["links"]]
                members = [np.frombuffer(b, np.int32) for b in r["members"]]
                own = np.frombuffer(r["own"], np.int64)
                got = search({"ids": np.frombuffer(r["ids"], np.int64), "count": count, "width": r["width"], "members": members,
                              "nodes": np.frombuffer(r["nodes"], np.float64).reshape(len(count), -1),
                              "links": [v.reshape(len(m), -1) for v, m in zip(links, members)]},
                             own, np.frombuffer(r["asked"], np.float64).reshape(len(own), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], names=["query_id", "vec_id", "score"])

    with small_batches(spark, 4):
        found = stored(work.select("own", "asked", "width", "ids", "count", "nodes", "members", "links")
                       .mapInArrow(run, "query_id long, vec_id long, score double"), "hnsw-found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
