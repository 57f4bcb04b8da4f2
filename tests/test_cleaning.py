"""Mini-cases for the cleaning operators (FIXTURES.md section 3)."""

import datetime as dt
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavepanel.columns import CLEAN
from wavepanel.functions import keys as K
from wavepanel.operators import clean as C
from wavepanel.operators.deflate import deflate
from wavepanel.operators.primary import exact_dedup

D = dt.date(2025, 9, 1)
SCHEMA = "_row_seq BIGINT, id STRING, Date DATE, employee_category STRING, " \
         "current_annual_contracted_salary DOUBLE, full_time_equivalent DOUBLE"


def _prune(spark, rows):
    df = spark.createDataFrame([(i, "p", D, cat, float(sal), fte) for i, (cat, sal, fte) in enumerate(rows, 1)], SCHEMA)
    return sorted(r._row_seq for r in C.prune_overallocated(df, CLEAN).collect())


@pytest.mark.parametrize("rows,kept", [
    ([("Limited", 100, 1.0), (None, 300, 0.5), (None, 200, 0.4), (None, 50, 0.1)], [1, 3]),
    ([(None, 300, 1.0), (None, 200, 0.5), (None, 100, 0.4)], [1, 3]),
    ([("Limited", 100, 0.5), ("Limited", 90, 0.5), (None, 300, 0.6)], [1, 3]),
    ([(None, 10, 1.5)], [1]),
    ([(None, 10, 1.0), (None, 5, 0.4)], [1, 2]),
    ([(None, 10, 1.2), (None, 9, 0.0), (None, 8, 0.5)], [1, 2]),      # zero weight always admitted
    ([(None, 10, None), (None, 9, 1.0), (None, 8, 0.5)], [1]),        # null-weight primary admits nobody
])
def test_prune_mini_cases(spark, rows, kept):
    assert _prune(spark, rows) == kept


def _pandas_prune(pdf, limit=1.4):
    """Independent restatement of the pruning rule (row order = _row_seq)."""
    keep = []
    for _, g in pdf.groupby(["id", "Date"], sort=False):
        if round(g["full_time_equivalent"].sum(), 9) <= limit:
            keep += list(g["_row_seq"])
            continue
        lim = g["employee_category"].fillna("").str.lower().str.contains("limited")
        pool = g[lim] if lim.any() else g
        prim = pool.sort_values(["current_annual_contracted_salary", "_row_seq"],
                                ascending=[False, True], kind="mergesort").iloc[0]
        rest = g[g["_row_seq"] != prim["_row_seq"]].sort_values(
            ["current_annual_contracted_salary", "_row_seq"], ascending=[False, True], kind="mergesort")
        keep.append(prim["_row_seq"])
        total = prim["full_time_equivalent"]
        for _, r in rest.iterrows():
            if total + r["full_time_equivalent"] <= limit:
                keep.append(r["_row_seq"])
                total += r["full_time_equivalent"]
    return sorted(int(x) for x in keep)


def test_prune_differential_random(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(1, 1500):
        rows.append((i, f"e{rnd.randrange(60)}", D if rnd.random() < .5 else dt.date(2024, 4, 1),
                     rnd.choice(["Limited Appointee", "Faculty", None, "Academic Staff"]),
                     float(rnd.randrange(1, 40) * 1000), rnd.randrange(0, 101) / 100))
    pdf = pd.DataFrame(rows, columns=["_row_seq", "id", "Date", "employee_category",
                                      "current_annual_contracted_salary", "full_time_equivalent"])
    got = sorted(r._row_seq for r in C.prune_overallocated(spark.createDataFrame(pdf, SCHEMA), CLEAN).collect())
    assert got == _pandas_prune(pdf)
    # invariant: every group that was over the limit ends within it, or keeps only its primary
    totals = pdf.groupby(["id", "Date"])["full_time_equivalent"].sum().round(9)
    out = pdf[pdf["_row_seq"].isin(got)]
    for key, g in out.groupby(["id", "Date"]):
        if totals[key] > 1.4:
            assert g["full_time_equivalent"].sum() <= 1.4 + 1e-9 or len(g) == 1


def test_prune_hot_groups(spark):
    """Hundreds of rows in a group, many of one weight: the bounded lists lose nothing."""
    rnd = random.Random(11)
    rows = [(i, f"e{rnd.randrange(3)}", D, rnd.choice(["Limited Appointee", None]),
             float(rnd.randrange(1, 30) * 1000), rnd.choice([0.0, 0.05, 0.1, 0.25, rnd.randrange(0, 60) / 100])) for i in range(1, 900)]
    pdf = pd.DataFrame(rows, columns=["_row_seq", "id", "Date", "employee_category",
                                      "current_annual_contracted_salary", "full_time_equivalent"])
    df = spark.createDataFrame(pdf, SCHEMA)
    for salts in (1, 7):
        assert sorted(r._row_seq for r in C.prune_overallocated(df, CLEAN, salts=salts).collect()) == _pandas_prune(pdf)


def test_prune_null_keys_and_plan(spark):
    df = spark.createDataFrame([(1, None, D, None, 10.0, 1.0), (2, None, D, None, 9.0, 1.0), (3, "a", None, None, 9.0, 1.0),
                                (4, "a", D, None, None, 1.0), (5, "a", D, None, 5.0, 1.0), (6, "b", D, None, 5.0, None)], SCHEMA)
    out = C.prune_overallocated(df, CLEAN)
    assert out.columns == df.columns
    assert sorted(r._row_seq for r in out.collect()) == [1, 3, 5, 6]
    import tempfile
    path = tempfile.mkdtemp(prefix="wavepanel-test-") + "/t"
    df.write.parquet(path)
    plan = C.prune_overallocated(spark.read.parquet(path), CLEAN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 4 and "collect_list" not in plan and plan.count("MapInArrow") == 1


def _walk(rows, limit=1.4):
    """The visiting walk of one group: (seq, measure, weight) rows, highest measure first."""
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    kept, total = [order[0][0]], order[0][2]
    for seq, _, w in order[1:]:
        if w is not None and total + w <= limit:
            kept.append(seq)
            total += w
    return sorted(kept)


@pytest.mark.parametrize("negative", [False, True])
def test_prune_a_large_group_of_distinct_weights(spark, negative):
    """One group of 300,000 rows with as many weights, and one with negative weights: no list of a group's rows."""
    n = 300_000
    df = spark.range(1, n + 1).select(
        F.col("id").alias("_row_seq"), F.lit("hot").alias("id"), F.lit(D).alias("Date"), F.lit(None).cast("string").alias("employee_category"),
        F.pmod(F.col("id") * 7919, F.lit(100_003)).cast("double").alias("current_annual_contracted_salary"),
        ((F.pmod(F.col("id") * 104_729, F.lit(n)) + 1) / F.lit(3.0e5 if negative else 2.0e7)
         * F.when(F.lit(negative) & (F.col("id") % 3 == 0), F.lit(-1.0)).otherwise(F.lit(1.0))).alias("full_time_equivalent"))
    rows = [(r._row_seq, r.current_annual_contracted_salary, r.full_time_equivalent) for r in df.collect()]
    assert len({r[2] for r in rows}) == n
    assert sorted(r._row_seq for r in C.prune_overallocated(df, CLEAN).collect()) == _walk(rows)


def test_prune_is_idempotent(spark):
    rnd = random.Random(3)
    rows = [(i, f"e{rnd.randrange(20)}", D, None, float(rnd.randrange(1, 9)), rnd.randrange(1, 90) / 100)
            for i in range(1, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    once = C.prune_overallocated(df, CLEAN)
    twice = C.prune_overallocated(once, CLEAN)
    assert sorted(r._row_seq for r in once.collect()) == sorted(r._row_seq for r in twice.collect())


def test_exact_dedup_keeps_first(spark):
    df = spark.createDataFrame([(1, "a", D, "T", 1.0, 1.0, "x"), (2, "a", D, "T", 1.0, 1.0, "y"),
                                (3, "a", D, None, 1.0, 1.0, "z"), (4, "a", D, None, 1.0, 1.0, "w")],
                               "_row_seq BIGINT, id STRING, Date DATE, title STRING, s DOUBLE, f DOUBLE, appt STRING")
    out = exact_dedup(df, ["id", "Date", "title", "s", "f"], "_row_seq")
    assert sorted((r._row_seq, r.appt) for r in out.collect()) == [(1, "x"), (3, "z")]


def _py_id(last, first, hire):
    key = f"{str(last).upper()}|{str(first).upper()}|{'' if hire is None else str(hire)[:10]}"
    return hashlib.md5(key.encode()).hexdigest()[:12]


def test_entity_id_matches_python_md5(spark):
    rows = [("Smith", "John", dt.date(2020, 1, 15)), (None, "Ann", dt.date(2019, 5, 1)),
            ("Lee ", "Bo", None), ("Lee", "Bo", None), ("Ünal", "çağla", dt.date(2001, 2, 3))]
    df = spark.createDataFrame(rows, "last STRING, first STRING, hire DATE")
    got = [r.id for r in df.select(K.entity_id("last", "first", "hire").alias("id")).collect()]
    want = [_py_id("nan" if a is None else a, b, c) for a, b, c in rows]
    assert got == want
    assert len(set(got)) == 5          # trailing space keeps a distinct id


def test_hire_date_reconcile(spark):
    cut = dt.date(2025, 5, 1)
    old, new = dt.date(2024, 4, 1), dt.date(2025, 9, 1)
    rows = [(1, "A", "X", old, dt.date(2000, 1, 1)), (2, "A", "X", old, dt.date(2001, 1, 1)),
            (3, "A", "X", new, dt.date(2010, 1, 1)),                            # two legacy dates: unchanged
            (4, "B", "Y", old, dt.date(2002, 1, 1)), (5, "B", "Y", old, None),
            (6, "b", "y", new, dt.date(2011, 1, 1)),                            # one legacy date: replaced
            (7, "C", "Z", new, dt.date(2012, 1, 1))]                            # only new: unchanged
    df = spark.createDataFrame(rows, "_row_seq BIGINT, last_name STRING, first_name STRING, Date DATE, "
                                     "date_of_hire DATE")
    out = {r._row_seq: r.date_of_hire for r in C.reconcile_hire_dates(df, cut, CLEAN).collect()}
    assert out[3] == dt.date(2010, 1, 1) and out[6] == dt.date(2002, 1, 1) and out[7] == dt.date(2012, 1, 1)


def test_jobcode_normalize(spark):
    df = spark.createDataFrame([("AB123U",), ("AB123Z",), ("AB12",), (None,)], "c STRING")
    assert [r.n for r in df.select(K.normalize_jobcode("c").alias("n")).collect()] == \
        ["AB123", "AB123Z", "AB12", None]


def test_recode_keeps_unmatched_and_null(spark):
    df = spark.createDataFrame([("FA",), ("ZZ",), (None,)], "c STRING")
    got = [r.r for r in df.select(K.recode("c", {"FA": "Faculty"}).alias("r")).collect()]
    assert got == ["Faculty", "ZZ", None]


def test_deflate_latest_fill_and_asof(spark):
    panel = spark.createDataFrame([(1, dt.date(1990, 1, 1), 10.0, 1.0), (2, dt.date(1996, 1, 1), 10.0, 1.0),
                                   (3, dt.date(2005, 1, 1), 10.0, 1.0)],
                                  "_row_seq BIGINT, Date DATE, current_annual_contracted_salary DOUBLE, "
                                  "full_time_equivalent DOUBLE")
    idx = spark.createDataFrame([(dt.date(1995, 1, 1), 2.0), (dt.date(1996, 1, 1), 1.5),
                                 (dt.date(1997, 1, 1), None), (dt.date(1998, 1, 1), 1.2)], "Date DATE, CPI_2021_Index DOUBLE")
    latest = {r._row_seq: r["2021_Index"] for r in deflate(panel, idx, CLEAN).collect()}
    assert latest == {1: 1.2, 2: 1.5, 3: 1.2}
    asof = {r._row_seq: r["2021_Index"] for r in deflate(panel, idx, CLEAN, mode="asof").collect()}
    assert asof == {1: None, 2: 1.5, 3: 1.2}
    cpi = idx.withColumn("CPI", F.lit(300.0) / F.col("CPI_2021_Index"))
    got = deflate(panel, cpi, CLEAN, carry=["CPI", "CPI_2021_Index"]).collect()
    assert {r._row_seq: (r.CPI, r.CPI_2021_Index) for r in got} == {1: (250.0, 1.2), 2: (200.0, 1.5), 3: (250.0, 1.2)}


def test_job_dimension_null_safe(spark):
    df = spark.createDataFrame([(1, None), (2, "AB123")], "_row_seq BIGINT, jobcode STRING")
    jobs = spark.createDataFrame([(None, "Blank"), ("AB123", "Admin")], "jobcode STRING, job_group STRING")
    out = {r._row_seq: r.jobgroup for r in C.attach_job_dimension(df, jobs, CLEAN).collect()}
    assert out == {1: "Blank", 2: "Admin"}


def test_not_faculty_keeps_null(spark):
    df = spark.createDataFrame([("Faculty",), (None,), ("Staff",)], "c STRING")
    assert df.where(~F.col("c").eqNullSafe("Faculty")).count() == 2


def _panel_rows(n=900, seed=5):
    """Raw rows with repeated and missing names, null dates and weights, over-allocated groups and exact duplicates."""
    rnd = random.Random(seed)
    rows = []
    for i in range(1, n):
        rows.append((i, rnd.choice([dt.date(1996, 1, 1), dt.date(1999, 1, 1), dt.date(1999, 1, 1), None]), rnd.choice([" Ann", "ann", "Bob", None]),
                     rnd.choice(["Lee", "lee ", "Ray"]), rnd.choice([dt.date(1990, 1, 1), dt.date(1991, 1, 1), None]), rnd.choice(["A", "B", None]),
                     rnd.choice(["X", "Y"]), rnd.choice(["t1", "t2"]), rnd.choice(["AB100U", "AB101", None]), rnd.choice(["FA", "LI", "Limited Appointee", None]),
                     "P", rnd.choice([0.1, 0.25, 0.5, 1.0, 0.0, None]), rnd.choice([10.0, 20.0, 30.0, None])))
    return rows + [(n + r[0], *r[1:]) for r in rows[:200]]


RAW = ("_row_seq long, Date date, last_name string, first_name string, date_of_hire date, division string, department string, title string, "
       "jobcode string, employee_category string, appt_type_length string, full_time_equivalent double, current_annual_contracted_salary double")


def test_cleaning_dealt_by_entity_gives_the_same_rows(spark, monkeypatch):
    """Facts by windows inside an entity, or by aggregates and joins when a name is hot."""
    raw = spark.createDataFrame(_panel_rows(), RAW)
    jobs = spark.createDataFrame([("AB100", "g", "s"), (None, "none", None)], "jobcode string, job_group string, job_subgroup string")
    job = lambda store: sorted(map(str, C.clean_panel(raw, None, jobs, hire_cutoff=dt.date(1998, 1, 1), store=store).collect()))
    assert C.names_are_even(raw)
    dealt = job(True)
    monkeypatch.setattr(C, "MIN_BUCKET_ROWS", 0)
    monkeypatch.setattr(C, "BUCKET_SKEW", 0)
    assert not C.names_are_even(raw)
    assert dealt == job(True) == job(False) and len(dealt) > 100
    assert C.names_are_even(raw.limit(0))


def test_stored_cleaning_moves_only_undecided_rows(spark):
    """After the stored step, rows outside the over-allocated groups are not shuffled, nor is the panel for its job codes."""
    raw = spark.createDataFrame(_panel_rows(), RAW)
    jobs = spark.createDataFrame([("AB100", "g", "s")], "jobcode string, job_group string, job_subgroup string").distinct()
    out = C.clean_panel(raw, None, jobs, hire_cutoff=dt.date(1998, 1, 1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(jobcode" not in plan
    settled = plan[plan.index("Union"):].split("FileScan parquet")[0]
    assert "Exchange" not in settled, settled


def test_hire_dates_leave_earlier_rows_out_of_the_join(spark):
    raw = spark.createDataFrame(_panel_rows(), RAW)
    plan = C.reconcile_hire_dates(raw, dt.date(1998, 1, 1), CLEAN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join")
