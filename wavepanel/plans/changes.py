"""Step 5 queries: baselines, consecutive-snapshot jumps, first-vs-last growth,
sub-period growth, title-level before/after."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..operators import aggregate as agg
from ..operators import change as CH
from ..operators.clean import add_analysis_flags
from ..operators.primary import first_last_records
from .common import R, panel_real, rs, with_sql
from .registry import query

PIVOT_FROM = _dt.date(1999, 1, 1)


def _pos(spark, sf_dir):
    return panel_real(spark, sf_dir).where(F.col(FX.weight) > 0)


_FLAGS_SQL = """
fac as (select distinct division from panel_real where fte > 0 and category = 'F' and division is not null),
flagged as (select p.*, (f.division is not null) as "IsFacultyDivision"
            from panel_real p left join fac f on p.division = f.division where p.fte > 0),
g as (select "IsFacultyDivision", job_group, snapshot_date, sum(fte) as f from flagged
      where job_group is not null group by all),
b as (select g.*, first(f order by snapshot_date) over (partition by "IsFacultyDivision", job_group) as s from g)"""


def _fte_changes(spark, sf_dir):
    p = add_analysis_flags(_pos(spark, sf_dir), FX, faculty_label="F")
    g = (p.na.drop(subset=["job_group"])
          .groupBy("IsFacultyDivision", "job_group", FX.date).agg(F.sum("fte").alias("fte")))
    return CH.baseline_changes(g, ["IsFacultyDivision", "job_group"], FX.date, "fte")


@query("fte_change_baseline", with_sql(f"""
select "IsFacultyDivision", job_group, snapshot_date, {rs('f', 4)} as fte, {rs('s', 4)} as start_fte,
       {rs('f - s', 4)} as fte_change, {rs('(f - s) / nullif(s, 0) * 100', 4)} as fte_pct_change from b""", _FLAGS_SQL))
def fte_change_baseline(spark, sf_dir):
    """FTE by (faculty-division flag, job group, date) vs the group's first value."""
    c = _fte_changes(spark, sf_dir)
    return c.select("IsFacultyDivision", "job_group", FX.date, R("fte", 4).alias("fte"),
                    R("start_fte", 4).alias("start_fte"), R("fte_change", 4).alias("fte_change"),
                    R("fte_pct_change", 4).alias("fte_pct_change"))


@query("fte_change_pivot_mean", with_sql(f"""
select job_group, {rs('avg(case when not "IsFacultyDivision" then f - s end)', 4)} as "false",
       {rs('avg(case when "IsFacultyDivision" then f - s end)', 4)} as "true"
from b where snapshot_date >= date '{PIVOT_FROM}' group by job_group""", _FLAGS_SQL))
def fte_change_pivot_mean(spark, sf_dir):
    """Mean FTE change per job group x faculty flag over dates >= min_date."""
    c = _fte_changes(spark, sf_dir).where(F.col(FX.date) >= F.lit(PIVOT_FROM))
    w = c.groupBy("job_group").pivot("IsFacultyDivision", [False, True]).agg(F.avg("fte_change"))
    return w.select("job_group", R("false", 4).alias("false"), R("true", 4).alias("true"))


_PAIRS_SQL = """
prim as (select * from (select *, row_number() over (partition by id, snapshot_date
           order by salary desc nulls last, row_id) as rn from panel_real where fte > 0) where rn = 1),
cal as (select snapshot_date, row_number() over (order by snapshot_date) - 1 as snap_idx
        from (select distinct snapshot_date from panel_real where fte > 0)),
pp as (select p.*, c.snap_idx from prim p join cal c on p.snapshot_date = c.snapshot_date),
pairs as (select a.id, a.snapshot_date as snapshot_date_before, b.snapshot_date as snapshot_date_after,
                 a.salary as salary_before, b.salary as salary_after, a.fte as fte_before, b.fte as fte_after,
                 a.division as division_before, b.division as division_after,
                 a.title as title_before, b.title as title_after,
                 a.category as category_before, b.category as category_after
          from pp a join pp b on a.id = b.id and b.snap_idx = a.snap_idx + 1),
jumps as (select *, (salary_after - salary_before) / salary_before * 100 as pct_change,
                 salary_after - salary_before as dollar_change,
                 coalesce(nullif(concat_ws('; ',
                     case when title_before is distinct from title_after then 'Title change' end,
                     case when division_before is distinct from division_after then 'Division transfer' end,
                     case when category_before is distinct from category_after then 'Category change' end), ''),
                   'Same title/division — pure salary increase') as reason
          from pairs
          where salary_before >= 30000 and salary_after >= 30000 and fte_before >= 0.5 and fte_after >= 0.5
            and category_after is distinct from 'F' and category_before is distinct from 'F')"""


def _jumps(spark, sf_dir):
    pairs = CH.consecutive_pairs(_pos(spark, sf_dir), FX)
    j = pairs.where((F.col("salary_before") >= 30000) & (F.col("salary_after") >= 30000)
                    & (F.col("fte_before") >= 0.5) & (F.col("fte_after") >= 0.5)
                    & ~F.col("category_after").eqNullSafe("F") & ~F.col("category_before").eqNullSafe("F"))
    return (j.withColumn("pct_change", (F.col("salary_after") - F.col("salary_before"))
                         / F.col("salary_before") * 100.0)
             .withColumn("dollar_change", F.col("salary_after") - F.col("salary_before"))
             .withColumn("reason", CH.change_reason(j, FX)))


@query("consecutive_jumps_top15", with_sql(f"""
select id, snapshot_date_before, snapshot_date_after, division_before, division_after, title_before, title_after,
       category_after, salary_before, salary_after, {rs('dollar_change')} as dollar_change,
       {rs('pct_change', 4)} as pct_change, reason
from jumps order by pct_change desc, id, snapshot_date_before limit 15""", _PAIRS_SQL))
def consecutive_jumps_top15(spark, sf_dir):
    """15 largest % raises between adjacent snapshots, with the likely reason."""
    j = _jumps(spark, sf_dir).orderBy(F.col("pct_change").desc(), "id", "snapshot_date_before").limit(15)
    return j.select("id", "snapshot_date_before", "snapshot_date_after", "division_before", "division_after",
                    "title_before", "title_after", "category_after", "salary_before", "salary_after",
                    R("dollar_change").alias("dollar_change"), R("pct_change", 4).alias("pct_change"), "reason")


@query("jump_reasons", with_sql(f"""
select reason, cast(count(*) as bigint) as pairs, {rs('median(pct_change)', 4)} as median_pct_change
from jumps group by reason""", _PAIRS_SQL))
def jump_reasons(spark, sf_dir):
    """B24 over all qualifying adjacent pairs: count and median raise per reason."""
    j = _jumps(spark, sf_dir)
    g = (j.groupBy("reason").agg(F.count(F.lit(1)).alias("pairs"))
          .join(agg.exact_quantiles(j, ["reason"], "pct_change", (0.5,)), "reason"))
    return g.select("reason", "pairs", R("p50", 4).alias("median_pct_change"))


@query("long_tenure_increase_top10", with_sql(f"""
select id, snapshot_date_first, snapshot_date_last, salary_first, salary_last,
       {rs('salary_last - salary_first')} as dollar_increase,
       {rs('(salary_last - salary_first) / salary_first * 100', 4)} as pct_increase
from fl where snapshot_date_last > snapshot_date_first + interval 730 day and salary_first >= 30000
order by (salary_last - salary_first) / salary_first desc, id limit 10""", """
fl as (select id, arg_min(snapshot_date, (snapshot_date, row_id)) as snapshot_date_first,
              arg_max(snapshot_date, (snapshot_date, row_id)) as snapshot_date_last,
              arg_min(salary, (snapshot_date, row_id)) as salary_first,
              arg_max(salary, (snapshot_date, row_id)) as salary_last
       from panel_real group by id)"""))
def long_tenure_increase_top10(spark, sf_dir):
    """First vs last record per entity, > 2 years apart, start >= 30k; top 10 by %."""
    fl = first_last_records(panel_real(spark, sf_dir), FX, [FX.date, "salary"])
    fl = fl.where((F.col("snapshot_date_last") > F.date_add("snapshot_date_first", 730))
                  & (F.col("salary_first") >= 30000))
    pct = (F.col("salary_last") - F.col("salary_first")) / F.col("salary_first")
    top = fl.orderBy(pct.desc(), "id").limit(10)
    return top.select("id", "snapshot_date_first", "snapshot_date_last", "salary_first", "salary_last",
                      R(F.col("salary_last") - F.col("salary_first")).alias("dollar_increase"),
                      R(pct * 100.0, 4).alias("pct_increase"))


@query("growth_by_category", with_sql(f"""
select category, cast(count(*) as bigint) as n, {rs('median(nominal_pct)', 4)} as median_nominal,
       {rs('median(real_pct)', 4)} as median_real, {rs('quantile_cont(real_pct, 0.9)', 4)} as pct_90,
       {rs('quantile_cont(real_pct, 0.1)', 4)} as pct_10
from lt where category is not null group by category""", """
prim as (select * from (select *, row_number() over (partition by id, snapshot_date
           order by salary desc nulls last, row_id) as rn from panel_real where fte > 0) where rn = 1),
s as (select * from prim where snapshot_date = (select min(snapshot_date) from panel_real where fte > 0)),
e as (select * from prim where snapshot_date = (select max(snapshot_date) from panel_real where fte > 0)),
lt as (select e.category as category,
              (e.salary - s.salary) / s.salary * 100 as nominal_pct,
              (e.real_pay - s.real_pay) / s.real_pay * 100 as real_pct
       from s join e on s.id = e.id where s.salary >= 30000 and e.salary >= 30000)"""))
def growth_by_category(spark, sf_dir):
    """Growth first->last snapshot by ending category (median, 10th/90th pct)."""
    fl = CH.first_last_snapshot(_pos(spark, sf_dir), FX, ["salary", "category", "real_pay"])
    lt = (fl.where((F.col("salary_start") >= 30000) & (F.col("salary_end") >= 30000))
            .select(F.col("category_end").alias("category"),
                    ((F.col("salary_end") - F.col("salary_start")) / F.col("salary_start") * 100.0).alias("nominal_pct"),
                    ((F.col("real_pay_end") - F.col("real_pay_start")) / F.col("real_pay_start") * 100.0).alias("real_pct"))
            .na.drop(subset=["category"]))
    k = ["category"]
    g = (lt.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
           .join(agg.exact_quantiles_of(lt, k, {"nominal_pct": "a", "real_pct": {0.5: "b", 0.9: "c", 0.1: "d"}}), k, "left"))
    return g.select("category", "n", R("a", 4).alias("median_nominal"), R("b", 4).alias("median_real"),
                    R("c", 4).alias("pct_90"), R("d", 4).alias("pct_10"))


def _growth_sql(keys: str) -> str:
    kcols = f"{keys}, " if keys else ""
    kjoin = f"and a.{keys} = b.{keys}" if keys else ""
    knn = f"and {keys} is not null" if keys else ""
    return with_sql(f"""
select {('b.' + keys + ', ') if keys else ''}a.snapshot_date as date_start, b.snapshot_date as date_end,
       {rs('a.f', 4)} as fte_start, {rs('b.f', 4)} as fte_end, {rs('b.f - a.f', 4)} as fte_change,
       {rs('a.v')} as salary_start, {rs('b.v')} as salary_end, {rs('b.v - a.v')} as salary_change,
       {rs('(b.v - a.v) / nullif(a.v, 0) * 100', 4)} as salary_pct_change,
       {rs('greatest(datediff(\'day\', a.snapshot_date, b.snapshot_date) / cast(30.44 as double), 1.0)', 4)} as months,
       {rs('case when a.v > 0 then (pow(b.v / a.v, cast(12.0 as double) / greatest(datediff(\'day\', a.snapshot_date, b.snapshot_date) / cast(30.44 as double), 1.0)) - 1.0) * 100.0 end', 4)} as annualized_pct_change
from t a join t b on b.snap_idx = a.snap_idx + 1 {kjoin}""", f"""
cal as (select snapshot_date, row_number() over (order by snapshot_date) - 1 as snap_idx
        from (select distinct snapshot_date from panel_real where fte > 0)),
t as (select {kcols}x.snapshot_date, c.snap_idx, sum(fte) as f, sum(real_pay) as v
      from panel_real x join cal c on x.snapshot_date = c.snapshot_date where fte > 0 {knn}
      group by {kcols}x.snapshot_date, c.snap_idx)""")


def _growth(spark, sf_dir, keys):
    p = _pos(spark, sf_dir)
    if keys:
        p = p.na.drop(subset=keys)
    series = p.groupBy(*keys, FX.date).agg(F.sum("fte").alias("f"), F.sum("real_pay").alias("v"))
    g = CH.period_growth(series, FX.date, keys, "f", "v", CH.calendar(_pos(spark, sf_dir), FX))
    return g.select(*keys, "date_start", "date_end", R("fte_start", 4).alias("fte_start"),
                    R("fte_end", 4).alias("fte_end"), R("fte_change", 4).alias("fte_change"),
                    R("salary_start").alias("salary_start"), R("salary_end").alias("salary_end"),
                    R("salary_change").alias("salary_change"),
                    R("salary_pct_change", 4).alias("salary_pct_change"), R("months", 4).alias("months"),
                    R("annualized_pct_change", 4).alias("annualized_pct_change"))


@query("subperiod_growth", _growth_sql(""))
def subperiod_growth(spark, sf_dir):
    """Change between adjacent snapshots, annualised."""
    return _growth(spark, sf_dir, [])


@query("subperiod_growth_by_type", _growth_sql("div_type"))
def subperiod_growth_by_type(spark, sf_dir):
    """Annualised sub-period growth per unit type (null when the base is 0)."""
    return _growth(spark, sf_dir, ["div_type"])


@query("title_full_outer_change", with_sql(f"""
select job_group, title, {rs('fs', 4)} as fte_start, ns as n_start, {rs('ss')} as sal_start,
       {rs('fe', 4)} as fte_end, ne as n_end, {rs('se')} as sal_end, {rs('fe - fs', 4)} as fte_change,
       {rs('se - ss')} as sal_change, {rs('case when ss > 0 then (se - ss) / ss * 100 end', 4)} as sal_pct_change
from (select job_group, title,
        coalesce(sum(case when snapshot_date = (select d0 from bounds) then fte end), 0) as fs,
        cast(count(distinct case when snapshot_date = (select d0 from bounds) then id end) as bigint) as ns,
        coalesce(sum(case when snapshot_date = (select d0 from bounds) then real_pay end), 0) as ss,
        coalesce(sum(case when snapshot_date = (select d1 from bounds) then fte end), 0) as fe,
        cast(count(distinct case when snapshot_date = (select d1 from bounds) then id end) as bigint) as ne,
        coalesce(sum(case when snapshot_date = (select d1 from bounds) then real_pay end), 0) as se
      from panel_real where fte > 0 and job_group is not null
        and snapshot_date in ((select d0 from bounds), (select d1 from bounds))
      group by job_group, title)""",
    "bounds as (select min(snapshot_date) as d0, max(snapshot_date) as d1 from panel_real where fte > 0)"))
def title_full_outer_change(spark, sf_dir):
    """Title-level before/after (full-outer semantics: missing side = 0),
    as one conditional aggregation instead of two aggregates and a full outer join."""
    p = _pos(spark, sf_dir).na.drop(subset=["job_group"])
    d0, d1 = agg.snapshot_bounds(p, FX)
    x = p.where((F.col(FX.date) == d0) | (F.col(FX.date) == d1))
    s, e = F.col(FX.date) == d0, F.col(FX.date) == d1
    g = x.groupBy("job_group", "title").agg(
        F.coalesce(F.sum(F.when(s, F.col("fte"))), F.lit(0.0)).alias("fs"),
        F.count_distinct(F.when(s, F.col("id"))).alias("n_start"),
        F.coalesce(F.sum(F.when(s, F.col("real_pay"))), F.lit(0.0)).alias("ss"),
        F.coalesce(F.sum(F.when(e, F.col("fte"))), F.lit(0.0)).alias("fe"),
        F.count_distinct(F.when(e, F.col("id"))).alias("n_end"),
        F.coalesce(F.sum(F.when(e, F.col("real_pay"))), F.lit(0.0)).alias("se"))
    return g.select("job_group", "title", R("fs", 4).alias("fte_start"), "n_start", R("ss").alias("sal_start"),
                    R("fe", 4).alias("fte_end"), "n_end", R("se").alias("sal_end"),
                    R(F.col("fe") - F.col("fs"), 4).alias("fte_change"),
                    R(F.col("se") - F.col("ss")).alias("sal_change"),
                    R(F.when(F.col("ss") > 0, (F.col("se") - F.col("ss")) / F.col("ss") * 100.0), 4)
                    .alias("sal_pct_change"))
