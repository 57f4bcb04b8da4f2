"""Step 4 queries: medians, quantiles, headcounts, histograms, box statistics,
regression, coverage, first-to-last change, two-grain summary, size guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..operators import aggregate as agg
from ..operators.primary import primary_rows
from ..sources import fixtures
from .common import R, panel_real, raw_snapshots, regression_ctes, rs, with_sql
from .registry import query


def _pos(spark, sf_dir):
    return panel_real(spark, sf_dir).where(F.col(FX.weight) > 0)


@query("group_median_mean", with_sql(f"""
select job_group, cast(count(salary) as bigint) as n, {rs('median(salary)', 6)} as median_salary,
       {rs('avg(salary)', 6)} as mean_salary
from panel_real where fte > 0 and job_group is not null group by job_group"""))
def group_median_mean(spark, sf_dir):
    """Count, median and mean per group (exact, interpolating median)."""
    g = agg.group_stats(_pos(spark, sf_dir), ["job_group"], "salary", quantiles=(0.5,))
    return g.select("job_group", "n", R("p50", 6).alias("median_salary"), R("mean", 6).alias("mean_salary"))


@query("group_quantiles", with_sql(f"""
select div_type, {rs('quantile_cont(real_salary, 0.1)', 6)} as p10, {rs('quantile_cont(real_salary, 0.25)', 6)} as p25,
       {rs('quantile_cont(real_salary, 0.75)', 6)} as p75, {rs('quantile_cont(real_salary, 0.9)', 6)} as p90
from panel_real where fte > 0 and div_type is not null group by div_type"""))
def group_quantiles(spark, sf_dir):
    """10/25/75/90th percentiles per group, linear interpolation."""
    g = agg.group_stats(_pos(spark, sf_dir), ["div_type"], "real_salary", quantiles=(0.1, 0.25, 0.75, 0.9))
    return g.select("div_type", *[R(c, 6).alias(c) for c in ("p10", "p25", "p75", "p90")])


@query("jobcode_medians", with_sql(f"""
select snapshot_date, title, {rs('median(salary)', 6)} as median_salary,
       {rs('median(real_salary)', 6)} as median_real_salary
from panel_real where title is not null group by snapshot_date, title"""))
def jobcode_medians(spark, sf_dir):
    """Median nominal and real measure by (date, code)."""
    p = panel_real(spark, sf_dir).na.drop(subset=["title"])
    k = [FX.date, "title"]
    g = agg.exact_quantiles_of(p, k, {"salary": "m", "real_salary": "r"})
    return g.select(FX.date, "title", R("m", 6).alias("median_salary"), R("r", 6).alias("median_real_salary"))


@query("category_headcount", with_sql(f"""
select category, cast(count(*) as bigint) as headcount, {rs('median(salary)', 6)} as median_salary
from panel_real where fte > 0 and category is not null group by category order by headcount desc"""))
def category_headcount(spark, sf_dir):
    """Headcount and median per category, sorted by headcount."""
    p = _pos(spark, sf_dir).na.drop(subset=["category"])
    g = (p.groupBy("category").agg(F.count(F.lit(1)).alias("headcount"))
          .join(agg.exact_quantiles(p, ["category"], "salary", (0.5,)), "category"))
    return g.select("category", "headcount", R("p50", 6).alias("median_salary")).orderBy(F.col("headcount").desc())


@query("global_stats", with_sql(f"""
select {rs('median(salary)', 6)} as median_salary, {rs('avg(salary)', 6)} as mean_salary,
       min(salary) as min_salary, max(salary) as max_salary from panel_real where fte > 0"""))
def global_stats(spark, sf_dir):
    """Global median, mean, min and max."""
    g = agg.group_stats(_pos(spark, sf_dir), [], "salary", quantiles=(0.5,))
    return g.select(R("p50", 6).alias("median_salary"), R("mean", 6).alias("mean_salary"),
                    F.col("min").alias("min_salary"), F.col("max").alias("max_salary"))


@query("median_trend", with_sql(f"""
select snapshot_date, category, {rs('median(salary)', 6)} as median_salary,
       cast(count(distinct id) as bigint) as employees, {rs('sum(fte)', 4)} as total_fte
from panel_real where fte > 0 and division = 'NATION_3' and category is not null
group by snapshot_date, category"""))
def median_trend(spark, sf_dir):
    """Median trend by date and category for one division."""
    p = _pos(spark, sf_dir).where(F.col("division") == "NATION_3").na.drop(subset=["category"])
    k = [FX.date, "category"]
    g = (p.groupBy(*k).agg(F.count_distinct("id").alias("employees"), F.sum("fte").alias("f"))
          .join(agg.exact_quantiles(p, k, "salary", (0.5,)).withColumnRenamed("p50", "m"), k))
    return g.select(FX.date, "category", R("m", 6).alias("median_salary"), "employees",
                    R("f", 4).alias("total_fte"))


@query("first_last_change", with_sql(f"""
select div_type, {rs('fv', 4)} as first_value, {rs('lv', 4)} as last_value, {rs('lv - fv', 4)} as change,
       {rs('case when fv > 0 then (lv - fv) / fv * 100 end', 4)} as pct_change from fl""", """
t as (select div_type, snapshot_date, sum(fte) as f from panel_real where fte > 0 and div_type is not null
      group by div_type, snapshot_date),
fl as (select div_type, arg_min(f, snapshot_date) as fv, arg_max(f, snapshot_date) as lv from t group by div_type)"""))
def first_last_change(spark, sf_dir):
    """First-to-last change of each column of a pivoted trend (only when the first value > 0)."""
    t = (_pos(spark, sf_dir).na.drop(subset=["div_type"])
         .groupBy("div_type", FX.date).agg(F.sum("fte").alias("f")))
    c = agg.first_last_change(t, ["div_type"], "f", FX.date)
    return c.select("div_type", R("first_value", 4).alias("first_value"), R("last_value", 4).alias("last_value"),
                    R("change", 4).alias("change"), R("pct_change", 4).alias("pct_change"))


@query("dept_summary_two_grain", with_sql("""
select a.org, a.median_salary, a.mean_salary, a.headcount, b.total_fte from a join b on a.org = b.org""", f"""
prim as (select * from (select *, row_number() over (partition by id, snapshot_date
           order by salary desc nulls last, row_id) as rn from panel_real) where rn = 1),
a as (select org, {rs('median(salary)', 6)} as median_salary, {rs('avg(salary)', 6)} as mean_salary,
             cast(count(*) as bigint) as headcount
      from prim where snapshot_date = (select max(snapshot_date) from panel_real) and org is not null group by org),
b as (select org, {rs('sum(fte)', 4)} as total_fte from panel_real
      where snapshot_date = (select max(snapshot_date) from panel_real) and org is not null group by org)"""))
def dept_summary_two_grain(spark, sf_dir):
    """Per unit at the latest date: median/mean/headcount over primary rows, FTE over all rows."""
    p = agg.at_latest(panel_real(spark, sf_dir), FX).na.drop(subset=[FX.org])
    prim = primary_rows(p, FX)
    a = (prim.groupBy(FX.org).agg(R(F.avg("salary"), 6).alias("mean_salary"),
                                  F.count(F.lit(1)).alias("headcount"))
             .join(agg.exact_quantiles(prim, [FX.org], "salary", (0.5,)), FX.org)
             .withColumn("median_salary", R("p50", 6)).drop("p50"))
    b = p.groupBy(FX.org).agg(R(F.sum("fte"), 4).alias("total_fte"))
    return a.join(b, FX.org)           # both sides: one row per unit


@query("min_group_guard", with_sql("""
select org, f, o, p from (
  select org, cast(count(case when category = 'F' then 1 end) as bigint) as f,
         cast(count(case when category = 'O' then 1 end) as bigint) as o,
         cast(count(case when category = 'P' then 1 end) as bigint) as p
  from panel_real where org is not null group by org) where least(f, o, p) >= 3"""))
def min_group_guard(spark, sf_dir):
    """Keep units where every group has >= 3 rows (a missing group counts 0)."""
    p = panel_real(spark, sf_dir).na.drop(subset=[FX.org])
    w = p.groupBy(FX.org).pivot("category", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    w = w.na.fill(0, ["F", "O", "P"])
    return (w.where(F.least("F", "O", "P") >= 3)
             .select(FX.org, F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p")))


@query("histogram20", with_sql(f"""
select bin, cast(count(*) as bigint) as count, {rs('lo + bin * (hi - lo) / 20', 4)} as bin_low,
       {rs('lo + (bin + 1) * (hi - lo) / 20', 4)} as bin_high from b group by bin, lo, hi""", """
r as (select min(salary) as lo, max(salary) as hi from panel_real where salary is not null
      and snapshot_date = (select max(snapshot_date) from panel_real)),
b as (select case when r.hi = r.lo then 0
                  else least(cast(floor((p.salary - r.lo) / ((r.hi - r.lo) / 20)) as int), 19) end as bin,
             r.lo, r.hi
      from panel_real p, r where p.salary is not null
       and p.snapshot_date = (select max(snapshot_date) from panel_real))"""))
def histogram20(spark, sf_dir):
    """20 equal-width bins of the measure at the latest snapshot."""
    h = agg.histogram(agg.at_latest(panel_real(spark, sf_dir), FX), "salary", 20)
    return h.select("bin", "count", R("bin_low", 4).alias("bin_low"), R("bin_high", 4).alias("bin_high"))


@query("box_stats", with_sql(f"""
select div_type, {rs('min(real_salary)')} as min, {rs('quantile_cont(real_salary, 0.25)', 6)} as q1,
       {rs('quantile_cont(real_salary, 0.5)', 6)} as median, {rs('quantile_cont(real_salary, 0.75)', 6)} as q3,
       {rs('max(real_salary)')} as max
from panel_real where fte > 0 and div_type is not null group by div_type"""))
def box_stats(spark, sf_dir):
    """Min, quartiles and max per group (box-plot data)."""
    g = agg.group_stats(_pos(spark, sf_dir), ["div_type"], "real_salary", quantiles=(0.25, 0.5, 0.75))
    return g.select("div_type", R("min").alias("min"), R("p25", 6).alias("q1"), R("p50", 6).alias("median"),
                    R("p75", 6).alias("q3"), R("max").alias("max"))


@query("tenure_regression", with_sql(f"""
select job_group, cast(n as bigint) as n, {rs('slope', 6)} as slope, {rs('intercept', 6)} as intercept from reg""",
    """
t as (select p.*, datediff('day', f.first_seen, p.snapshot_date) / cast(365.25 as double) as tenure
      from panel_real p join (select id, min(snapshot_date) as first_seen from panel_real group by id) f
      on p.id = f.id where p.fte > 0 and p.job_group is not null),
tt as (select * from t where tenure is not null and salary is not null),
""" + regression_ctes("tt", ["job_group"], "salary", "tenure")))
def tenure_regression(spark, sf_dir):
    """Least-squares salary-on-tenure line per group (>= 3 points, tenure varies)."""
    p = panel_real(spark, sf_dir)
    first = p.groupBy("id").agg(F.min(FX.date).alias("first_seen"))
    t = (p.where(F.col(FX.weight) > 0).join(first, "id")
          .withColumn("tenure", F.datediff(FX.date, "first_seen") / F.lit(365.25))
          .na.drop(subset=["job_group"]))
    r = agg.linear_trend(t, "salary", "tenure", ["job_group"])
    return r.select("job_group", "n", R("slope", 6).alias("slope"), R("intercept", 6).alias("intercept"))


_COVER_FIELDS = ["last_name", "first_name", "date_of_hire", "jobcode", "title", "employee_category"]


@query("field_coverage", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
""" + " union all ".join(
    f"select '{f}' as field, cast(count(case when coalesce(cast({f} as varchar), '') <> '' then 1 end) as bigint) "
    f"as non_empty from raw" for f in _COVER_FIELDS))
def field_coverage(spark, sf_dir):
    """Non-empty values per field."""
    return agg.field_coverage(raw_snapshots(spark, sf_dir), _COVER_FIELDS)
