"""op3 and op7: against brute force."""

import numpy as np
import pytest

from wavepanel.llm import hnsw, neardup_vectors, queries

SF = "/root/testdata/sf0.001"


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) if c is not None else None for c in v], 0) for i, v in zip(ids, x)],
                                 "vec_id long, embedding array<float>, label int")


def clustered(n=1500, d=24, seed=0):
    """Loose points, tight clusters, a chain, exact copies; lengths differ."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[100:400] = x[0] + r.normal(scale=0.12, size=(300, d))
    x[400:460] = x[1]
    for i in range(460, 520):
        x[i] = x[i - 1] + r.normal(scale=0.08, size=d)
    return (x * r.uniform(0.5, 3, size=(n, 1))).astype(np.float32).astype(float)


def brute_links(ids, x, t):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    g = y @ y.T >= t
    np.fill_diagonal(g, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[g[i]].min()) if g[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            return {(int(a), int(k), int(ids[c]), bool(a == ids[c])) for a, k, c in zip(ids, g.sum(1), label)}
        label = new


@pytest.mark.parametrize("tile", [2048, 100])
def test_tiled_comparison(spark, tile):
    x, ids = clustered(), np.arange(1500)
    got = {tuple(r) for r in neardup_vectors.near_duplicates(frame(spark, ids.tolist(), x), tile=tile).collect()}
    assert got == brute_links(ids, x, 0.9)


BAD = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [None] + [1.0] * 23), (9005, [float("inf")] * 24), (9006, []), (9007, [1.0])]


def test_vectors_that_take_no_part(spark):
    import pyspark.sql.functions as F
    x = clustered()[:200]
    df = frame(spark, list(range(200)) + [i for i, _ in BAD], [*x, *(v for _, v in BAD)])
    df = df.select("*", *[F.lit(1).alias(c) for c in ("v", "id", "copies", "tile", "shard")])
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(df).collect()}
    assert len(got) == 200 + len(BAD)
    for i, _ in BAD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    near = hnsw.nearest(df, df).collect()
    assert {r["vec_id"] for r in near} | {r["query_id"] for r in near} <= set(range(200))
    empty = df.limit(0)
    assert neardup_vectors.near_duplicates(empty).collect() == [] and hnsw.nearest(empty, empty).collect() == []
    assert hnsw.nearest(frame(spark, [1], [[1.0, 2.0]]), frame(spark, [1], [[1.0, 2.0]])).collect() == []


def test_repeated_and_null_ids(spark):
    df = frame(spark, [1, 1, 2, None], [[1.0, 0.0], [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)], key=str)


def test_tile_pairs_are_not_shuffled(spark, monkeypatch):
    """Of the vectors there are two stored copies and a shuffle for each, however many tile pairs there are."""
    plans, kept = {}, neardup_vectors.stored

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        plans[name, "types"] = {t for _, t in df.dtypes}
        out = kept(df, name)
        if name == "vector-tiles":
            plans["bytes"] = out.selectExpr("sum(length(data)) as b").first()["b"]
        return out

    monkeypatch.setattr(neardup_vectors, "stored", spied)
    x, ids = clustered(), np.arange(1500)
    got = {tuple(r) for r in neardup_vectors.near_duplicates(frame(spark, ids.tolist(), x), tile=100).collect()}
    assert got == brute_links(ids, x, 0.9)
    assert "Exchange" not in plans["vector-links"]
    with_vectors = {n for n, _ in (k for k in plans if isinstance(k, tuple)) if plans[n, "types"] & {"binary", "array<float>", "array<double>"}}
    assert with_vectors == {"vector-classes", "vector-tiles"}
    assert plans["bytes"] == len(np.unique(x, axis=0)) * 24 * 4      # single precision stays single


def test_vectors_in_double_precision(spark):
    x, ids = clustered()[:400] + 1e-12, np.arange(400)
    df = spark.createDataFrame([(i, v) for i, v in zip(ids.tolist(), x.tolist())], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in neardup_vectors.near_duplicates(df, tile=100).collect()} == brute_links(ids, x, 0.9)


def test_keys_of_vectors_never_clash(spark, monkeypatch):
    """A seed under which two vectors share a key is passed over; a vector with a null shares no key with the one without."""
    import pyspark.sql.functions as F
    real = neardup_vectors.vector_key
    monkeypatch.setattr(neardup_vectors, "vector_key", lambda seed: F.lit(7).cast("long") if seed == 0 else real(seed))
    x, ids = clustered()[:300], np.arange(300)
    df = frame(spark, ids.tolist() + [900, 901], [*x, [None, *x[0]], [*x[0], None]])
    got = {tuple(r) for r in neardup_vectors.near_duplicates(df).collect()}
    assert got == brute_links(ids, x, 0.9) | {(900, 0, 900, True), (901, 0, 901, True)}


def test_links_are_added_up_within_a_task(monkeypatch):
    """Whatever the room for held counts, ids occur a few times only and sum to all links."""
    import pyarrow as pa
    x = clustered(600)
    ids, links, label = (np.array(v) for v in zip(*[(i, k, c) for i, k, c, _ in sorted(brute_links(np.arange(600), x, 0.9))]))
    _, axes = np.linalg.eigh(x.T @ x)
    tiles = [np.arange(a, a + 100) for a in range(0, 600, 100)]
    rows = [(p, q) for p in range(6) for q in range(p, 6)]
    batch = pa.RecordBatch.from_pydict({"tile": [p for p, _ in rows], "other": [q for _, q in rows]}
                                       | {c + e: [f(tiles[r[k]]) for r in rows] for k, e in ((0, ""), (1, "2"))
                                          for c, f in (("ids", lambda t: t.tobytes()), ("copies", lambda t: np.ones(len(t), np.int64).tobytes()),
                                                       ("data", lambda t: x[t].tobytes()))})
    for held in (1 << 18, 100):
        monkeypatch.setattr(neardup_vectors, "HELD", held)
        out = pa.Table.from_batches(list(neardup_vectors.compare(axes, 8, 0.9, "float64")(iter([batch]))))
        got = np.bincount(out["id"].to_numpy(), out["links"].to_numpy(), 600)
        assert got.tolist() == links.tolist()
        if held > 600:                                               # one row an id, one label a component
            assert len(out) == len(set(out["id"].to_pylist())) and dict(zip(out["id"].to_pylist(), out["label"].to_pylist())) == \
                {i: c for i, c, k in zip(ids.tolist(), label.tolist(), links.tolist()) if k}


def recall(rows, ids, x, asked, k=20):
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    for q in asked:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:k]]
        got = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
        assert all((a["score"], -a["vec_id"]) >= (b["score"], -b["vec_id"]) for a, b in zip(got, got[1:]))
        assert all(abs(r["score"] - x[ids == r["vec_id"]][0] @ x[ids == q][0]) < 1e-9 for r in got)
        hit, total = hit + len({r["vec_id"] for r in got} & set(want.tolist())), total + len(want)
    return hit / total


@pytest.mark.parametrize("shard", [4096, 300])
def test_graph_search(spark, shard):
    x, ids = clustered(), np.arange(1500)
    df = frame(spark, ids.tolist(), x)
    got = hnsw.nearest(df, df.where("vec_id % 20 = 0"), shard=shard).collect()
    assert len(got) == 75 * 20
    assert recall(got, ids, x, range(0, 1500, 20)) > 0.95


def test_registered_search(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    got = queries.QUERIES["op3_nearest_neighbours"](spark, SF).collect()
    assert recall(got, ids, x, [i for i in ids if i % 20 == 0]) > 0.95


def shapes(n=3000, d=32, seed=1):
    """Data on which a beam of fixed width, or links to the nearest alone, lose neighbours."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    centres = r.normal(size=(n // 60, d))
    tight = np.repeat(centres, 60, 0) + 0.05 * r.normal(size=(n // 60 * 60, d))
    return {"normal": x, "lengths": x * np.exp(r.normal(0, 0.25, size=(n, 1))), "long tails": x * np.exp(r.normal(0, 1, size=(n, 1))),
            "clusters of 60": tight / np.linalg.norm(tight, axis=1)[:, None]}


@pytest.mark.parametrize("shape", ["normal", "lengths", "long tails", "clusters of 60"])
def test_recall_does_not_depend_on_the_data(spark, shape):
    x = shapes()[shape].astype(np.float32).astype(float)
    ids = np.arange(len(x))
    df = frame(spark, ids.tolist(), x)
    got = hnsw.nearest(df, df.where("vec_id % 20 = 0"), shard=1600).collect()
    assert recall(got, ids, x, range(0, len(x), 20)) >= 0.95


def test_graph_hangs_together():
    """Tight groups larger than a node's links; far pairs; copies."""
    x = shapes()["clusters of 60"]
    for y in (x, np.concatenate([x[:100], x[:3] + 100, x[:2] - 100])):
        links = hnsw.link(y, hnsw.DEGREE, hnsw.CANDIDATES)
        joined = hnsw.join_parts(y, links)
        assert len(np.unique(hnsw.parts(joined))) == 1
        assert (joined[:, :links.shape[1]] == links)[links >= 0].all() and joined.max() < len(y)     # nothing is lost
    assert hnsw.join_parts(x[:1], hnsw.link(x[:1], 16, 48)).shape[0] == 1


def test_a_shard_without_a_good_beam_is_scanned():
    x = np.random.default_rng(2).normal(size=(25, 8))
    index = hnsw.build(np.arange(25), x)
    assert index["width"] == 0                                   # fewer nodes than the narrowest beam
    q, found, score = hnsw.search(index, np.array([3]), x[3:4], 20)
    best = np.argsort(-(x @ x[3]), kind="stable")
    assert found.tolist() == [i for i in best if i != 3][:20]


def test_search_with_ties_repeated_rows_and_null_ids(spark):
    """Equal scores go to the smaller id, repeated rows count each, null ids take no part."""
    rows = [(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(50, [0.5, 0.0]), (50, [0.5, 0.0]), (None, [9.0, 0.0]), (60, [0.0, 1.0])]
    df = frame(spark, [i for i, _ in rows], [v for _, v in rows])
    got = {}
    for r in hnsw.nearest(df, df.where("vec_id = 20 or vec_id = 60 or vec_id is null"), k=42).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {20, 60}
    assert [v for _, v, _ in sorted(got[20])] == [i for i in range(1, 41) if i != 20] + [50, 50, 60]
    assert [(v, s) for _, v, s in sorted(got[60])][:3] == [(1, 0.0), (2, 0.0), (3, 0.0)]
