"""Every registered query with an oracle equals DuckDB on the same tables."""

import os

import pytest

from tools.oracle_check import duck, same_rows
from wavepanel.plans import REGISTRY

from .conftest import SF001

# sf0.001 keeps the suite quick; set ORACLE_SF_DIR=/root/testdata/sf0.01 for the driver's scale.
SF = os.environ.get("ORACLE_SF_DIR", SF001)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    df = q.build(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        assert len(df.columns) > 0
        return
    cur = con.execute(q.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    ok, diff = same_rows(df.columns, rows, dcols, drows)
    assert ok, diff
