"""Physical-plan checks and the driver contract."""

import importlib

import pytest

from wavepanel.plans import REGISTRY

from .conftest import SF001


def _plan(df):
    """The formatted physical plan (what `df.explain("formatted")` prints)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_entry_contract(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.count() > 0
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 90


def test_dimension_joins_are_broadcast(spark):
    from wavepanel.sources import fixtures
    p = _plan(fixtures.panel(spark, SF001))
    assert "BroadcastExchange" in p                      # nation x region (25 rows by spec)
    from wavepanel.plans.common import deflated_panel
    p2 = _plan(deflated_panel(spark, SF001))
    assert "BroadcastHashJoin" in p2                     # per-date price index


def test_cleaning_job_leaves_the_jvm_once(spark):
    """The operator's own plan (the query returns a scan of the stored copy): Python sees the undecided rows of the pruning alone."""
    from wavepanel.operators.clean import clean_panel
    from wavepanel.plans.cleaning import CUTOFF, DIVISION_MAP
    from wavepanel.plans.common import raw_snapshots
    from wavepanel.sources import fixtures
    job = lambda store: _plan(clean_panel(raw_snapshots(spark, SF001), fixtures.price_index(spark), fixtures.job_dimension(spark, SF001),
                                          hire_cutoff=CUTOFF, division_map=DIVISION_MAP, price_date="d", price_value="idx", store=store))
    for plan in (job(True), job(False)):
        tree = plan.split("\n\n(1)")[0]
        assert not any(n in tree for n in ("EvalPython", "InPandas")) and tree.count("MapInArrow") == 1
    # deduplicated rows are read by the groups' totals (an exchange that is used twice), the undecided rows and the
    # filter, the job dimension's two tables once each
    initial = job(True).split("\n\n(1)")[0]
    assert initial.count("Scan parquet") <= 4 + 3


@pytest.mark.parametrize("name", ["trend_total", "compare_by_division", "peer_percentile",
                                  "subperiod_growth", "uniform_cut"])
def test_no_python_in_native_queries(spark, name):
    p = _plan(REGISTRY[name].build(spark, SF001))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p and "MapInPandas" not in p


def test_scan_prunes_columns(spark):
    from wavepanel.columns import FIXTURE as FX
    from wavepanel.operators.aggregate import overview
    from wavepanel.sources import fixtures
    df = overview(fixtures.panel(spark, SF001), FX.with_(jobcode="title"))
    plan = _plan(df)
    # only the columns the overview needs are read from orders, and the
    # lineitem branch (weights, unused here) is removed from the plan entirely
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz," \
           "o_orderpriority:string>" in plan
    assert "lineitem" not in plan and "o_totalprice" not in plan


def test_pushed_filter_reaches_scan(spark):
    from pyspark.sql import functions as F
    from wavepanel.sources.tables import read_table
    df = read_table(spark, SF001, "orders").where(F.col("o_totalprice") > 1000).select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in _plan(df)
