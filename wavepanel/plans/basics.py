"""Step 1 queries: trend, overview, headline, primary row, deflation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..operators import aggregate as agg
from ..operators.cube import cube_trend
from ..operators.primary import primary_rows
from .common import R, deflated_panel, panel, panel_real, rs, trend_cube, with_sql
from .registry import query


@query("trend_total", with_sql(f"""
select snapshot_date, cast(count(distinct id) as bigint) as employees,
       {rs('sum(fte)', 4)} as total_fte,
       {rs('sum(pay)', 4)} as total_salary_nominal,
       {rs('sum(real_pay)')} as total_salary_real,
       {rs('sum(real_pay)/sum(fte)')} as salary_per_fte_real
from panel_real where fte > 0 group by snapshot_date"""))
def trend_total(spark, sf_dir):
    """Per-snapshot headcount, FTE, nominal and real pay (zero-FTE rows excluded)."""
    t = cube_trend(trend_cube(spark, sf_dir), FX)
    return t.select(FX.date, "employees", R("total_fte", 4).alias("total_fte"),
                    R("total_salary_nominal", 4).alias("total_salary_nominal"),
                    R("total_salary_real").alias("total_salary_real"),
                    R("salary_per_fte_real").alias("salary_per_fte_real"))


@query("overview", with_sql("""
select min(snapshot_date) as first_date, max(snapshot_date) as last_date,
       cast(count(*) as bigint) as records, cast(count(distinct id) as bigint) as entities,
       cast(count(distinct division) as bigint) as divisions,
       cast(count(distinct department) as bigint) as departments,
       cast(count(distinct title) as bigint) as jobcodes
from panel"""))
def overview(spark, sf_dir):
    """Date range, record count and distinct entities / units / codes."""
    return agg.overview(panel(spark, sf_dir), FX.with_(jobcode="title"))


@query("headline_latest", with_sql(f"""
select max(snapshot_date) as snapshot, cast(count(distinct id) as bigint) as employees,
       {rs('sum(fte)', 4)} as total_fte, {rs('sum(real_pay)')} as total_salary_real,
       cast(count(distinct department) as bigint) as departments
from panel_real where fte > 0 and snapshot_date = (select max(snapshot_date) from panel_real where fte > 0)"""))
def headline_latest(spark, sf_dir):
    """D5 + B13: latest-snapshot headline numbers."""
    h = agg.headline(panel_real(spark, sf_dir).where(F.col(FX.weight) > 0), FX)
    return h.select("snapshot", "employees", R("total_fte", 4).alias("total_fte"),
                    R("total_salary_real").alias("total_salary_real"), "departments")


@query("primary_appointment", with_sql("""
select row_id, id, snapshot_date, salary, fte from (
  select *, row_number() over (partition by id, snapshot_date
                               order by salary desc nulls last, row_id) as rn
  from panel) where rn = 1"""))
def primary_appointment(spark, sf_dir):
    """Highest-salary row per (entity, snapshot); ties keep the first row."""
    return primary_rows(panel(spark, sf_dir), FX).select("row_id", "id", FX.date, "salary", "fte")


@query("deflate_latest_fill", with_sql(f"""
select row_id, snapshot_date, idx, {rs('pay', 4)} as pay, {rs('real_pay', 4)} as real_pay,
       {rs('real_salary', 4)} as real_salary from panel_real"""))
def deflate_latest_fill(spark, sf_dir):
    """C1/B8/B10 (as coded): index by date, misses filled by the latest non-null index row; pay and real pay."""
    p = deflated_panel(spark, sf_dir, mode="latest")
    return p.select("row_id", FX.date, "idx", R("pay", 4).alias("pay"),
                    R("real_pay", 4).alias("real_pay"), R("real_salary", 4).alias("real_salary"))


@query("deflate_asof", with_sql(f"""
select p.row_id, p.snapshot_date,
       (select idx from price_index i where i.d <= p.snapshot_date and i.idx is not null
        order by i.d desc limit 1) as idx,
       {rs('''p.salary * (select idx from price_index i where i.d <= p.snapshot_date and i.idx is not null
        order by i.d desc limit 1)''', 4)} as real_salary
from panel p"""))
def deflate_asof(spark, sf_dir):
    """C1 option: nearest prior index row (as-of on the snapshot calendar)."""
    p = panel_real(spark, sf_dir, mode="asof")
    return p.select("row_id", FX.date, "idx", R("real_salary", 4).alias("real_salary"))
