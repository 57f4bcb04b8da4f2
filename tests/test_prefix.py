"""Distributed running totals, and the greedy tolerance match on sorted salaries."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavepanel.operators import prefix
from wavepanel.operators import scenarios as S
from wavepanel.operators.matching import assign, pieces, tolerance_match


@pytest.fixture(autouse=True, scope="module")
def many_partitions(spark):
    """Small inputs would be put into one partition."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def plan_of(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    hot = [(i, "hot", 5, r.randint(-3, 9)) for i in range(3000)]            # one value holds most rows
    return hot + [(3000 + i, "x", r.randint(0, 10), r.choice([None, 1, 7])) for i in range(1500)]


def test_running_total_and_count(spark, rows):
    df = spark.createDataFrame(rows, "seq long, name string, k int, v int").repartition(7)
    order = [F.col("k").desc(), F.col("seq")]
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    total, sums = 0, {}
    for r in want:
        total += r[3] or 0
        sums[r[0]] = total
    assert {r.seq: r.t for r in prefix.running_total(df, order, F.col("v"), "t").collect()} == sums
    counted = prefix.running_count(df, order, "n")
    assert {r.seq: r.n for r in counted.collect()} == {r[0]: i for i, r in enumerate(want, 1)}
    assert "SinglePartition" not in plan_of(spark, counted) and "Window" not in plan_of(spark, counted)
    parts = [r["n"] for r in prefix.ordered(df, order).groupBy(prefix.PART).agg(F.count("*").alias("n")).collect()]
    assert len(parts) > 4 and max(parts) < len(rows) / 3                     # the popular value is split
    none = df.limit(0)
    assert prefix.running_count(none, order, "n").collect() == [] and prefix.running_total(none, order, F.col("v"), "t").collect() == []


def test_until(spark):
    r = random.Random(9)
    rows = [(i, r.choice([None, 100.0, 50.0, 50.0, 25.0, -10.0])) for i in range(4000)]
    df = spark.createDataFrame(rows, "seq long, s double").repartition(5)
    order = sorted((x for x in rows if x[1] is not None), key=lambda x: (-x[1], x[0]))
    for target in (0.0, 1.0, 100.0, 40_000.0, 80_010.0, 100_000.0, 1e9):
        want, run = [], 0.0
        for seq, s in order:
            if run >= target:
                break
            want.append(seq)
            run += s
        got = prefix.until(df, "s", [F.col("seq")], target)
        assert sorted(x.seq for x in got.collect()) == sorted(want), target
        assert "SinglePartition" not in plan_of(spark, got)
    assert S.take_until(df.limit(0), "s", 10.0, "seq").collect() == []


def walk(lines, records, tolerance):
    """The reference's loop: nearest first, each record once."""
    used, out = set(), {}
    for line, d, t, s in sorted(lines):
        for near in (5, tolerance):
            hit = next((i for diff, i in sorted((abs(p - s), i) for i, rd, rt, p in records if (rd, rt) == (d, t) and p is not None and s is not None)
                        if i not in used and diff < near), None)
            if hit is not None:
                break
        if hit is not None:
            used.add(hit)
        out[line] = hit
    return out


@pytest.mark.parametrize("seed", range(4))
def test_match_against_the_loop(spark, seed):
    r = random.Random(seed)
    spread = (200, 1500, 30_000, 300)[seed]
    pay = lambda: float(r.choice([r.randrange(spread), r.randrange(0, spread, 50), 100 * (spread // 200)]))
    lines = [(i, r.choice("AB"), r.choice("xy"), r.choice([None, *[pay() for _ in range(9)]])) for i in range(120)]
    records = [(i, r.choice(["A", "B", None]), r.choice("xy"), r.choice([None, *[pay() for _ in range(9)]])) for i in r.sample(range(10_000), 160)]
    plan = spark.createDataFrame(lines, "line long, department string, title string, salary double")
    recs = spark.createDataFrame(records, "rid long, dept string, title string, s double")
    got = {x.line: x.record for x in tolerance_match(plan, recs, "dept", "title", "s", "rid").collect()}
    assert got == walk(lines, records, 100)


def test_lines_out_of_reach_fall_into_pieces(spark):
    plan = spark.createDataFrame([(i, "D", "T", float(s)) for i, s in enumerate([0, 150, 450, 1200, 1500])],
                                 "line long, department string, title string, salary double")
    got = {r.cell: r.piece for r in pieces(plan, 200.0).collect()}
    assert got[0] == got[1] == got[2] == got[-1] and got[6] == got[7] and got[2] != got[6]


def test_a_hundred_thousand_equal_lines(spark):
    n = 100_000
    name = lambda c: F.when(F.col("id") >= 0, F.lit(c))  # noqa: E731 - not a constant to the optimiser
    plan = spark.range(n).select(F.col("id").alias("line"), name("D").alias("department"), name("T").alias("title"), F.lit(70_000.0).alias("salary"))
    recs = spark.range(n + 5000).select(F.col("id").alias("rid"), name("D").alias("dept"), name("T").alias("title"),
                                        (F.lit(70_000.0) + F.pmod("id", F.lit(7)) * 30).alias("s"))
    t = time.time()
    out = tolerance_match(plan, recs, "dept", "title", "s", "rid")
    got = np.array(sorted((r.line, -1 if r.record is None else r.record) for r in out.collect()))
    assert time.time() - t < 60
    # nearest salaries first (70,000, then 30, 60 and 90 above), ids ascending; those at 120 and more are out of reach
    ids = np.arange(n + 5000)
    want = np.concatenate([ids[ids % 7 == k] for k in range(4)])
    assert (got[:len(want), 1] == want).all() and (got[len(want):, 1] == -1).all()
    assert "BroadcastNestedLoop" not in plan_of(spark, out) and "Cartesian" not in plan_of(spark, out)


def test_assign_breaks_ties_by_record():
    took = assign(np.array([100.0, 100.0, 100.0, 100.0]), np.array([90.0, 110.0, 110.0, 90.0]), np.array([7, 3, 9, 1]), 20.0)
    assert took.tolist() == [3, 1, 0, 2]
    assert assign(np.array([1.0]), np.array([]), np.array([]), 5.0).tolist() == [-1]
