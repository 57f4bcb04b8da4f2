"""op13: against a plain-Python run of the same rounds, and against SQL."""

import hashlib

import numpy as np
import pytest

from wavepanel.llm import centroids, queries
from tools.oracle_check import duck, same_rows

SF = "/root/testdata/sf0.001"
D = 64


def frame(spark, rows, extra=()):
    made = [(i, None if v is None else [None if c is None else float(c) for c in v], 0) + tuple(range(len(extra))) for i, v in rows]
    return spark.createDataFrame(made, "vec_id long, embedding array<double>, label int" + "".join(f", `{c}` int" for c in extra))


def plain(rows, k=16, rounds=3):
    kept = [(i, [(int(n) * 64) // d for n, d in (float(c).as_integer_ratio() for c in v)]) for i, v in rows
            if v is not None and len(v) == D and all(c is not None and np.isfinite(c) for c in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in named[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        cent = [[sum(col) // len(own) for col in zip(*own)] if (own := [v for (_, v), j in zip(kept, of) if j == c]) else cent[c]
                for c in range(len(cent))]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    fits = lambda n: n if n < 1 << 63 else None
    whole = sum(d for *_, d in got)
    return sorted(((i, c, fits(d), fits(sum(x for _, j, x in got if j == c)), fits(whole),
                    hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, c, d in got), key=str)


def run(df):
    return sorted((tuple(r) for r in centroids.op13_clusters(df).collect()), key=str)


def made(n, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    return [(int(i), (r.normal(size=D) * scale).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [made(400), made(9, 1), made(60, 2, 1e7), made(40, 3, 1e30),
                                  [(i, [float((i * j) % 3 - 1) for j in range(D)]) for i in range(300)]])
def test_rounds_match_plain_python(spark, rows):
    """Ordinary, few, wide and very wide components (beyond 64 bits), and many exact ties and copies."""
    assert run(frame(spark, rows)) == plain(rows)


def test_edges(spark):
    good = made(80, 5)
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63),
           (905, [float("inf")] * D), (906, [1.0] * 65)]
    odd = [(None, [0.0] * D), (3, good[4][1]), (3, good[4][1]), (77, [-0.01] * D)]
    assert run(frame(spark, good + bad + odd, ("v", "cluster", "distance", "limb", "n"))) == plain(good + odd)
    assert run(frame(spark, bad)) == []
    assert run(frame(spark, [])) == []
    one = run(frame(spark, [(5, [0.5] * D)]))
    assert [(r[0], r[1], r[2], r[4]) for r in one] == [(5, 0, 0, 0)]


def test_bracket_ties_go_to_the_smaller_number():
    b = centroids.Bracket([[2, 0], [0, 2], [0, 0], [2, 2], [1, 1]])
    number, distance = b.nearest(np.array([[1, 1], [1, 0], [2, 1], [5, 5], [0, 1]]))
    assert number.tolist() == [4, 0, 0, 3, 1] and distance.tolist() == [0, 1, 1, 18, 1]


def test_matches_sql(spark):
    df = queries.QUERIES["op13_centroid_clusters"](spark, SF)
    cur = duck(SF).execute(queries.ORACLE["op13_centroid_clusters"])
    cols = [c[0] for c in cur.description]
    ok, diff = same_rows(df.columns, [tuple(r) for r in df.collect()], cols, cur.fetchall())
    assert ok, diff
