"""The panel laid out by entity: no exchange on the id, the same rows, and a way out for a hot entity."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wavepanel.columns import FIXTURE as FX
from wavepanel.operators import change as CH
from wavepanel.operators import peers as P
from wavepanel.operators import primary as PR
from wavepanel.plans.common import deflated_panel
from wavepanel.sources import sinks

from .conftest import SF001


@pytest.fixture(scope="module")
def laid_out(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="wavepanel-test-"), "panel")
    source = deflated_panel(spark, SF001)
    assert sinks.write_entity_panel(source, path, FX.id, [FX.date], buckets=8)
    return source, path


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Joins as they are when neither side is small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def tree(df):
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return text.split("\n\n(1)")[0].split("Subqueries")[0]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


VIEWS = {
    "primary rows": lambda p: PR.primary_rows(p, FX),
    "entity index": lambda p: PR.entity_index(p, FX).drop("is_current"),
    "first and last records": lambda p: PR.first_last_records(p, FX),
    "previous unit per snapshot": lambda p: CH.previous_value(p, FX, FX.org, per="snapshot"),
    "previous unit per row": lambda p: CH.previous_value(p, FX, FX.org),
    "concurrent appointments": lambda p: P.concurrent_appointments(p, FX),
    "growth in division": lambda p: P.growth_in_current_division(p, FX),
    "joined by entity": lambda p: p.join(p.groupBy(FX.id).agg(F.max(FX.date).alias("m")), FX.id),
}


@pytest.mark.parametrize("name", VIEWS)
def test_views_of_entities_need_no_exchange(spark, laid_out, name):
    source, path = laid_out
    out = VIEWS[name](sinks.read_entity_panel(spark, path))
    assert "Exchange" not in tree(out), tree(out)
    assert rows(out) == rows(VIEWS[name](source))


def test_columns_and_filters_still_reach_the_files(spark, laid_out):
    p = sinks.read_entity_panel(spark, laid_out[1]).where(F.col("fte") > 0.5).select("id", "salary")
    plan = spark._jvm.PythonSQLUtils.explainString(p._jdf.queryExecution(), "formatted")
    assert "GreaterThan(fte,0.5)" in plan and "ReadSchema: struct<id:bigint,fte:double,salary:double>" in plan


def test_a_hot_entity_keeps_the_plain_layout(spark, monkeypatch):
    monkeypatch.setattr(sinks, "MIN_BUCKET_ROWS", 10)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("id"), F.col("id").alias("v"))
    path = os.path.join(tempfile.mkdtemp(prefix="wavepanel-test-"), "hot")
    assert not sinks.write_entity_panel(df, path, "id", buckets=16)
    assert rows(sinks.read_entity_panel(spark, path)) == rows(df)
    empty = os.path.join(tempfile.mkdtemp(prefix="wavepanel-test-"), "none")
    sinks.write_entity_panel(df.limit(0), empty, "id")
    assert sinks.read_entity_panel(spark, empty).collect() == []


def test_null_ids_stay(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "id string, v int")
    path = os.path.join(tempfile.mkdtemp(prefix="wavepanel-test-"), "nulls")
    sinks.write_entity_panel(df, path, "id", buckets=4)
    assert rows(sinks.read_entity_panel(spark, path)) == rows(df)
