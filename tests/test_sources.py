"""Snapshot files, dimension loaders, sinks and pages."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wavepanel.sources import fixtures
from wavepanel.sources.dimensions import load_job_dimension, load_price_index
from wavepanel.sources.pages import page_records
from wavepanel.sources.sinks import read_panel, write_csv, write_panel
from wavepanel.sources.snapshots import (detect_layout, layout_frames, list_snapshot_files, normalize_name, probe_columns,
                                         read_snapshots, roles, snapshot_date)

from .conftest import SF001
from .page_parser import parse_page


def _scratch():
    return tempfile.mkdtemp(prefix="wavepanel-test-")


def _export_snapshots(spark, folder):
    """Write the sf0.001 raw rows as one CSV per yearly snapshot in two layouts."""
    raw = fixtures.raw_snapshots(spark, SF001)
    legacy, new = layout_frames(raw, fixtures.NEW_LAYOUT_FROM)
    years = [r.Date for r in raw.select("Date").distinct().collect()]      # bounded: one per snapshot
    for d in sorted(years):
        frame = legacy if d < fixtures.NEW_LAYOUT_FROM else new
        tmp = os.path.join(folder, f"_tmp_{d:%Y}")
        (frame.where(F.col("Date") == F.lit(d)).drop("Date", "_row_seq").coalesce(1)
              .write.option("header", True).csv(tmp))
        part = [f for f in os.listdir(tmp) if f.startswith("part-")][0]
        os.link(os.path.join(tmp, part), os.path.join(folder, f"Salaries {d:%Y-%m}.csv"))
    return raw


def test_layout_detection():
    assert detect_layout(["Last Name", "Pay Rate Type"]) == "new"
    assert detect_layout(["Pay Basis", "x"]) == "legacy"
    assert detect_layout(["x"]) == "unknown"


def test_snapshot_date_from_file_name(spark):
    df = spark.createDataFrame([("s3://b/run-12-3/Salaries 2025-09.csv",), ("/x/none.csv",)], "p STRING")
    assert [r.d for r in df.select(snapshot_date("p").alias("d")).collect()] == [dt.date(2025, 9, 1), None]


def test_read_snapshots_roundtrip(spark):
    folder = _scratch()
    raw = _export_snapshots(spark, folder)
    assert len(list_snapshot_files(spark, folder)) == 7
    got = read_snapshots(spark, folder)
    assert got.count() == raw.count()
    a = got.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("current_annual_contracted_salary").alias("s"))
    b = raw.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("current_annual_contracted_salary").alias("s"))
    assert sorted((r.Date, r.n, round(r.s, 2)) for r in a.collect()) == \
        sorted((r.Date, r.n, round(r.s, 2)) for r in b.collect())
    assert got.where(F.col("date_of_hire").isNotNull()).count() == raw.where(F.col("date_of_hire").isNotNull()).count()


def _csv(folder, name, rows, header="Last Name,First Name,Division,Pay Basis,Annual Full Salary,Full-Time Equivalent"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(header + "\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))


@pytest.mark.parametrize("sep", ["_", " "])
def test_every_file_of_a_date_is_kept_in_order(spark, sep):
    folder = _scratch()
    rows = lambda k: [(f"L{k}{i}", "F", "D", "Annual", 100 * k + i, 1) for i in range(3)]
    _csv(folder, f"Pay{sep}2025-09{sep}part1.csv", rows(1))
    _csv(folder, f"Pay{sep}2025-09{sep}part2.csv", rows(2))
    _csv(folder, f"Pay{sep}2025-10/part-00000-1234-4321-13ab.csv", rows(3))        # a folder of part files
    _csv(folder, f"Pay{sep}2025-10/part-00001-2026-13ab.csv", [("L40", "F", "D", "Salaried", "not a number", 0.5)],
         "Last Name,First Name,Division,Pay Rate Type,Annualized Rate Amount,FTE")
    got = sorted(read_snapshots(spark, folder).collect(), key=lambda r: r._row_seq)
    assert [r._row_seq for r in got] == list(range(10))
    assert [r.last_name for r in got] == ["L10", "L11", "L12", "L20", "L21", "L22", "L30", "L31", "L32", "L40"]
    assert got[9].current_annual_contracted_salary is None and got[9].full_time_equivalent == 0.5
    last = read_snapshots(spark, folder, keep="last", since=dt.date(2025, 9, 1))
    assert sorted(r.last_name for r in last.where(F.col("Date") == dt.date(2025, 9, 1)).collect()) == ["L20", "L21", "L22"]


def test_a_bad_month_is_an_error(spark):
    folder = _scratch()
    _csv(folder, "Pay_2026-13.csv", [("a", "b", "c", "Annual", 1, 1)])
    with pytest.raises(Exception, match="no such month"):
        read_snapshots(spark, folder).collect()


def test_row_numbers_over_many_partitions(spark):
    folder = _scratch()
    for k in range(150):
        _csv(folder, f"Pay_{2000 + k // 12}-{k % 12 + 1:02d}.csv", [(f"L{k}", "F", "D", "Annual", k, 1)] * 2)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))      # a partition per file
    try:
        rows = {r._row_seq: r.last_name for r in read_snapshots(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert rows == {i: f"L{i // 2}" for i in range(300)}


def test_names_and_roles(spark):
    assert normalize_name(" Full-Time Equivalent ") == "full-time_equivalent"
    assert normalize_name(" Full-Time Equivalent ", hyphens=True) == "full_time_equivalent"
    assert roles(["Last Name", "First-Name", "FTE", "Annual Full Salary", "Title"]) == {
        "salary": "Annual Full Salary", "fte": "FTE", "first_name": "First-Name", "last_name": "Last Name", "title": "Title"}
    df = spark.createDataFrame([("a", "b", "D", "T", "12x"), ("a", "b", None, "T", "12")],
                               "`First Name` string, `Last Name` string, Department string, Title string, Annual_Full_Salary string")
    assert [(r.salary, r.fte, r.name_key) for r in probe_columns(df).collect()] == [(None, 1.0, "B|A"), (12.0, 1.0, "B|A")]
    with pytest.raises(ValueError, match="salary"):
        probe_columns(df.drop("Annual_Full_Salary"))


def test_dimension_loaders(spark):
    folder = _scratch()
    jobs = fixtures.job_dimension(spark, SF001).withColumnRenamed("jobcode", "job_code") \
        .withColumn("job_code", F.lower("job_code"))
    write_csv(jobs, os.path.join(folder, "jobs"), columns=["job_code", "title", "job_group", "job_subgroup"], fill="")
    dim = load_job_dimension(spark, os.path.join(folder, "jobs"))
    assert dim.count() == jobs.count()
    assert dim.where(F.col("jobcode") != F.upper("jobcode")).count() == 0
    cpi = spark.createDataFrame([(dt.date(2021, 11, 1), 280.0, None), (dt.date(2022, 11, 1), 300.0, None)],
                                "Date DATE, CPI DOUBLE, CPI_2021_Index DOUBLE")
    write_csv(cpi, os.path.join(folder, "cpi"))
    idx = load_price_index(spark, os.path.join(folder, "cpi"), base_date=dt.date(2021, 11, 1))
    got = {r.Date: r.CPI_2021_Index for r in idx.collect()}
    assert got[dt.date(2021, 11, 1)] == 1.0 and abs(got[dt.date(2022, 11, 1)] - 280 / 300) < 1e-12


def test_panel_sink_partitioned(spark):
    folder = _scratch()
    raw = fixtures.raw_snapshots(spark, SF001).withColumn("id", F.col("_row_seq") % 17)
    path = os.path.join(folder, "panel")
    write_panel(raw, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("Date=")) == \
        [f"Date={y}-01-01" for y in range(1995, 2002)]
    back = read_panel(spark, path)
    assert back.count() == raw.count()
    one = back.where(F.col("Date") == F.lit(dt.date(2000, 1, 1)))
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(Date" in plan


def test_page_records_handle_script_and_entities(spark):
    html = ('<html lang="en"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body>'
            '<nav><ul><li><a href="/x">X</a></li></ul></nav><article><h1>A &amp; B</h1>'
            '<p>one<br><p>two  words</p></article></body></html>')
    pages = spark.createDataFrame([(1, html), (2, "<html><body><p>x</p></body></html>"), (3, None)], "page_id long, html string")
    assert [r.asDict() for r in page_records(pages).collect()] == [
        {"page_id": 1, "title": "A & B", "lang": "en", "heading": "A & B", "links": "X", "n_links": 1, "n_paragraphs": 2, "text": "one two words"}]


def test_page_records_match_a_parser(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r.asDict() for r in page_records(pages).collect()}
    assert len(got) == pages.count()                 # every fixture page has a title
    for r in pages.collect():
        assert got[r.page_id] == parse_page(r.page_id, r.html)


def test_job_rows_of_many_files_in_file_order(spark):
    """The first row of a code by file name and position, whatever Spark packs together."""
    folder = _scratch()
    for name, first, n in (("a.csv", "small", 1), ("b.csv", "large", 3000), ("c.csv", "last", 10)):
        with open(os.path.join(folder, name), "w") as f:
            f.write("job_code,job_group\n" + "".join(f"{'x1' if i == n - 1 else 'y' + str(i)},{first}{i}\n" for i in range(n)) + f"x1,{first}-again\n")
    got = {r.jobcode: r.job_group for r in load_job_dimension(spark, folder).collect()}
    assert got["X1"] == "small0" and got["Y0"] == "large0" and got["Y2000"] == "large2000"
