"""Trends from entity bitmaps equal those from count_distinct."""

import random

import pytest
from pyspark.sql import functions as F

from wavepanel.columns import PanelCols
from wavepanel.operators import aggregate as agg
from wavepanel.operators import cube as C

PC = PanelCols(id="id", date="d", division="div", category="cat", weight="w", weighted="p", real_weighted="r")


@pytest.fixture(scope="module")
def panel(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *[f"e{r.randrange(400)}" for _ in range(30)]]), f"20{r.randrange(20, 24)}-01-01", r.choice(["A", "B", None]), r.choice("xyz"),
             r.random(), r.random() * 100, r.random() * 90) for _ in range(5000)]
    return spark.createDataFrame(rows, "id string, d string, div string, cat string, w double, p double, r double").withColumn("d", F.to_date("d"))


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("by", [[], ["div"], ["cat"], ["div", "cat"]])
def test_trends_equal_count_distinct(panel, by):
    cube = C.entity_cube(panel, ["div", "cat"], PC)
    assert rows(C.cube_trend(cube, PC, by)) == rows(agg.trend(panel, PC, by))


def test_numbers_are_dense_and_follow_the_unit(panel):
    got = {r.id: r.entity_no for r in C.number_entities(panel, PC).collect()}
    assert sorted(got.values()) == list(range(1, len(got) + 1)) and None not in got
    last = {}
    for r in panel.where("id is not null").collect():
        last[r.id] = max(last.get(r.id, (r.d, "")), (r.d, r.div or ""))
    order = [last[i][1] for i in sorted(got, key=got.get)]
    assert order == sorted(order)


def test_more_entities_than_a_block(spark):
    n = 100_000
    df = spark.range(3 * n).select((F.col("id") % n).cast("string").alias("id"), F.lit("2020-01-01").cast("date").alias("d"),
                                   (F.col("id") % 7).cast("string").alias("div"), F.lit("c").alias("cat"),
                                   *[F.lit(1.0).alias(c) for c in ("w", "p", "r")])
    cube = C.entity_cube(df, ["div"], PC)
    assert cube.select("block").distinct().count() == 4
    assert [r.employees for r in C.cube_trend(cube, PC).collect()] == [n]
    assert rows(C.cube_trend(cube, PC, ["div"])) == rows(agg.trend(df, PC, ["div"]))


def test_empty(panel):
    cube = C.entity_cube(panel.limit(0), ["div"], PC)
    assert cube.collect() == [] and C.cube_trend(cube, PC, ["div"]).collect() == []
