"""Step 3 queries: trends by key, before/after comparisons, shares, pivots,
top-k, search, pickers, union by name."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..functions import present
from ..operators import aggregate as agg
from ..operators import primary
from ..operators.cube import cube_trend
from .common import R, panel, panel_real, rs, trend_cube, with_sql
from .registry import query

YEARS = list(range(1995, 2002))
CALENDAR = [_dt.date(y, 1, 1) for y in YEARS]          # the fixture's snapshots


def _pos(spark, sf_dir):
    """Deflated fixture panel without zero-weight (courtesy) rows."""
    return panel_real(spark, sf_dir).where(F.col(FX.weight) > 0)


def _trend_sql(keys: str, where: str = "") -> str:
    return with_sql(f"""
select snapshot_date, {keys}, cast(count(distinct id) as bigint) as employees,
       {rs('sum(fte)', 4)} as total_fte, {rs('sum(real_pay)')} as total_salary_real
from panel_real where fte > 0 {where} and {' and '.join(k.strip() + ' is not null' for k in keys.split(','))}
group by snapshot_date, {keys}""")


def _trend_out(t, keys):
    return t.select(FX.date, *keys, "employees", R("total_fte", 4).alias("total_fte"),
                    R("total_salary_real").alias("total_salary_real"))


@query("trend_by_type", _trend_sql("div_type"))
def trend_by_type(spark, sf_dir):
    """Trend by snapshot and unit type."""
    return _trend_out(cube_trend(trend_cube(spark, sf_dir), FX, by=["div_type"]), ["div_type"])


@query("trend_one_type_by_division", _trend_sql("division", "and div_type = 'ASIA'"))
def trend_one_type_by_division(spark, sf_dir):
    """D3: trend by snapshot and division within one unit type."""
    p = trend_cube(spark, sf_dir).where(F.col("div_type") == "ASIA")
    return _trend_out(cube_trend(p, FX, by=["division"]), ["division"])


@query("trend_jobgroup_nonnull", _trend_sql("job_group"))
def trend_jobgroup_nonnull(spark, sf_dir):
    """Trend by snapshot and job group, null groups dropped."""
    return _trend_out(cube_trend(trend_cube(spark, sf_dir), FX, by=["job_group"]), ["job_group"])


def _cmp_sql(keys: str, ctes_extra: str = "", tail: str = "") -> str:
    return f"""
bounds as (select min(snapshot_date) as d0, max(snapshot_date) as d1 from panel_real where fte > 0),
cmp as (
  select {keys},
    coalesce(sum(case when snapshot_date = (select d0 from bounds) then fte end), 0.0) as fte_start,
    coalesce(sum(case when snapshot_date = (select d1 from bounds) then fte end), 0.0) as fte_end,
    coalesce(sum(case when snapshot_date = (select d0 from bounds) then real_pay end), 0.0) as salary_start,
    coalesce(sum(case when snapshot_date = (select d1 from bounds) then real_pay end), 0.0) as salary_end
  from panel_real where fte > 0 and {' and '.join(k.strip() + ' is not null' for k in keys.split(','))}
    and snapshot_date in ((select d0 from bounds), (select d1 from bounds))
  group by {keys}
  having coalesce(sum(case when snapshot_date = (select d0 from bounds) then fte end), 0.0) <> 0
      or coalesce(sum(case when snapshot_date = (select d1 from bounds) then fte end), 0.0) <> 0)
{ctes_extra}"""


CMP_COLS_SQL = f"""{rs('fte_start', 4)} as fte_start, {rs('fte_end', 4)} as fte_end,
  {rs('fte_end - fte_start', 4)} as fte_change, {rs('(fte_end - fte_start) / nullif(fte_start, 0) * 100', 4)} as fte_pct_change,
  {rs('salary_start')} as salary_start, {rs('salary_end')} as salary_end,
  {rs('salary_end - salary_start')} as salary_change,
  {rs('(salary_end - salary_start) / nullif(salary_start, 0) * 100', 4)} as salary_pct_change"""


def _cmp_out(c, keys):
    return c.select(*keys, R("fte_start", 4).alias("fte_start"), R("fte_end", 4).alias("fte_end"),
                    R("fte_change", 4).alias("fte_change"), R("fte_pct_change", 4).alias("fte_pct_change"),
                    R("salary_start").alias("salary_start"), R("salary_end").alias("salary_end"),
                    R("salary_change").alias("salary_change"),
                    R("salary_pct_change", 4).alias("salary_pct_change"))


@query("compare_by_division", with_sql(f"select division, {CMP_COLS_SQL} from cmp", _cmp_sql("division")))
def compare_by_division(spark, sf_dir):
    """First vs last snapshot by division in one conditional aggregation."""
    return _cmp_out(agg.compare_snapshots(_pos(spark, sf_dir), ["division"], FX), ["division"])


@query("display_formats", with_sql(f"""
select division, strftime((select d0 from bounds), '%Y-%m') as first_label, strftime((select d1 from bounds), '%B %Y') as last_label,
       '$' || format('{{:,}}', cast(floor(salary_end + 0.5) as bigint)) as pay,
       '$' || case when salary_change < 0 then '-' else '+' end || format('{{:,}}', cast(floor(abs(salary_change) + 0.5) as bigint)) as pay_change,
       case when fte_change < 0 then '-' else '+' end || format('{{:,.2f}}', abs(fte_change)) as fte_change,
       case when fte_pct_change is null then 'New'
            else case when fte_pct_change < 0 then '-' else '+' end || format('{{:,.1f}}', abs(fte_pct_change)) || '%' end as fte_pct
from (select division, {CMP_COLS_SQL} from cmp)""", _cmp_sql("division")))
def display_formats(spark, sf_dir):
    """The report's display strings of a comparison: money, signed money, signed numbers and percentages, months."""
    p = _pos(spark, sf_dir)
    d0, d1 = agg.snapshot_bounds(p, FX)
    c = _cmp_out(agg.compare_snapshots(p, ["division"], FX), ["division"])
    return c.select("division", present.month_label(d0).alias("first_label"), present.month_label(d1, long=True).alias("last_label"),
                    present.money("salary_end").alias("pay"), present.signed_money("salary_change").alias("pay_change"),
                    present.signed_number("fte_change", 2).alias("fte_change"), present.signed_pct("fte_pct_change").alias("fte_pct"))


@query("compare_cross_topk", with_sql(f"""
select c.division, c.job_group, {CMP_COLS_SQL} from cmp c
where c.division in (select division from (
   select division, sum(fte) as f from panel_real
   where fte > 0 and snapshot_date = (select d1 from bounds) and division is not null
   group by division order by f desc, division limit 10))""", _cmp_sql("division, job_group")))
def compare_cross_topk(spark, sf_dir):
    """before/after division x job group for the 10 largest divisions (empty cells dropped)."""
    p = _pos(spark, sf_dir)
    last = agg.at_latest(p, FX)
    top = (last.groupBy("division").agg(F.sum(FX.weight).alias("_f"))
               .orderBy(F.col("_f").desc(), "division").limit(10).select("division"))
    c = agg.compare_snapshots(p, ["division", "job_group"], FX)
    c = c.join(F.broadcast(top), "division", "left_semi")     # top-k: 10 rows
    return _cmp_out(c, ["division", "job_group"])


# The named unit types: shown and totalled; any other type is neither.
NAMED_TYPES = ["AMERICA", "ASIA", "EUROPE"]
_NAMED_SQL = ", ".join(f"'{t}'" for t in NAMED_TYPES)


@query("compare_total_rollup", with_sql(f"""
select div_type, {CMP_COLS_SQL} from cmp where div_type in ({_NAMED_SQL})
union all
select 'TOTAL' as div_type, {CMP_COLS_SQL} from (
  select sum(fte_start) as fte_start, sum(fte_end) as fte_end,
         sum(salary_start) as salary_start, sum(salary_end) as salary_end from cmp where div_type in ({_NAMED_SQL}))""",
                                        _cmp_sql("div_type")))
def compare_total_rollup(spark, sf_dir):
    """Comparison by named type plus their TOTAL row with recomputed percentages."""
    c = agg.compare_snapshots(_pos(spark, sf_dir), ["div_type"], FX)
    return _cmp_out(agg.with_total_row(c, "div_type", ["fte", "salary"], parts=NAMED_TYPES), ["div_type"])


@query("cross_tab_keep_zeros", with_sql(f"""
select k.title, t.div_type, {rs('coalesce(fte_start, 0)', 4)} as fte_start, {rs('coalesce(fte_end, 0)', 4)} as fte_end,
       {rs('coalesce(fte_end, 0) - coalesce(fte_start, 0)', 4)} as fte_change,
       {rs('coalesce(salary_end, 0) - coalesce(salary_start, 0)')} as salary_change
from (select title from panel_real where fte > 0 and snapshot_date = (select d1 from bounds) and title is not null
      group by title order by {rs('sum(fte)', 4)} desc, title limit 10) k
cross join (select unnest([{_NAMED_SQL}, 'NOWHERE']) as div_type) t
left join cmp c on c.title = k.title and c.div_type = t.div_type""", _cmp_sql("title, div_type")))
def cross_tab_keep_zeros(spark, sf_dir):
    """before/after cross-tab of the 10 largest titles by named type, empty cells kept as zeros."""
    c = agg.cross_tab(_pos(spark, sf_dir), "title", "div_type", NAMED_TYPES + ["NOWHERE"], 10, FX)
    return c.select("title", "div_type", R("fte_start", 4).alias("fte_start"), R("fte_end", 4).alias("fte_end"),
                    R("fte_change", 4).alias("fte_change"), R("salary_change").alias("salary_change"))


@query("top_divisions_headcount", with_sql("""
select division, cast(count(*) as bigint) as employees from panel_real
where division is not null and snapshot_date = (select max(snapshot_date) from panel_real)
group by division order by employees desc, division limit 10"""))
def top_divisions_headcount(spark, sf_dir):
    """the 10 largest divisions by rows of the latest snapshot (ties by name)."""
    last = agg.at_latest(panel_real(spark, sf_dir), FX)
    g = last.na.drop(subset=["division"]).groupBy("division").agg(F.count(F.lit(1)).alias("employees"))
    return agg.top_k(g, "employees", ["division"], 10)


@query("dept_jobgroup_proportion", with_sql(f"""
select division, department, snapshot_date, job_group, {rs('f', 4)} as fte,
       {rs('sum(f) over (partition by division, department, snapshot_date)', 4)} as total_fte,
       {rs('f / sum(f) over (partition by division, department, snapshot_date)', 6)} as fte_proportion
from (select division, department, snapshot_date, job_group, sum(fte) as f from panel_real
      where fte > 0 and division is not null and department is not null and job_group is not null
      group by all)"""))
def dept_jobgroup_proportion(spark, sf_dir):
    """FTE share of each job group inside (division, department, date)."""
    g = agg.group_proportion(_pos(spark, sf_dir), FX, ["division", "department"], "job_group")
    return g.select("division", "department", FX.date, "job_group", R(FX.weight, 4).alias("fte"),
                    R("total_fte", 4).alias("total_fte"), R("fte_proportion", 6).alias("fte_proportion"))


@query("type_share", with_sql(f"""
select snapshot_date, div_type, {rs('v')} as value, {rs('f', 4)} as fte,
       {rs('v / sum(v) over (partition by snapshot_date) * 100', 4)} as value_share,
       {rs('f / sum(f) over (partition by snapshot_date) * 100', 4)} as fte_share
from (select snapshot_date, div_type, sum(real_pay) as v, sum(fte) as f from panel_real
      where fte > 0 and div_type in ('AMERICA','ASIA','EUROPE','AFRICA') group by all)"""))
def type_share(spark, sf_dir):
    """Each named type's share of the per-date total (named types only)."""
    s = agg.share_of_total(_pos(spark, sf_dir), FX, part="div_type", value="real_pay",
                           parts=["AMERICA", "ASIA", "EUROPE", "AFRICA"])
    return s.select(FX.date, "div_type", R("value").alias("value"), R("fte", 4).alias("fte"),
                    R("value_share", 4).alias("value_share"), R("fte_share", 4).alias("fte_share"))


@query("admin_share", with_sql(f"""
select snapshot_date, {rs('v / tot * 100', 4)} as value_share from (
  select snapshot_date, sum(case when div_type = 'EUROPE' then real_pay end) as v, sum(real_pay) as tot
  from panel_real where fte > 0 and div_type in ('AMERICA','ASIA','EUROPE','AFRICA') group by snapshot_date)"""))
def admin_share(spark, sf_dir):
    """The share table restricted to one type."""
    s = agg.share_of_total(_pos(spark, sf_dir), FX, part="div_type", value="real_pay",
                           parts=["AMERICA", "ASIA", "EUROPE", "AFRICA"])
    return s.where(F.col("div_type") == "EUROPE").select(FX.date, R("value_share", 4).alias("value_share"))


_PIVOT_COLS = ", ".join(
    f"{rs(f'sum(case when snapshot_date = make_date({y},1,1) then fte end)', 4)} as \"{y}-01-01\""
    for y in YEARS)


@query("dept_fte_pivot", with_sql(f"""
select division, department, {_PIVOT_COLS} from panel_real
where fte > 0 and division is not null and department is not null group by division, department"""))
def dept_fte_pivot(spark, sf_dir):
    """FTE by (division, department) x snapshot date, wide."""
    w = agg.pivot_by_date(_pos(spark, sf_dir), ["division", "department"], FX, dates=CALENDAR)
    return w.select("division", "department",
                    *[R(F.col(f"`{c}`"), 4).alias(c) for c in w.columns if c not in ("division", "department")])


@query("unpivot_fte", with_sql(" union all ".join(
    f"select division, department, '{y}-01-01' as snapshot, "
    f"{rs(f'sum(case when snapshot_date = make_date({y},1,1) then fte end)', 4)} as fte "
    f"from panel_real where fte > 0 and division is not null and department is not null group by division, department"
    for y in YEARS)))
def unpivot_fte(spark, sf_dir):
    """The wide pivot back to long (missing cells kept as nulls)."""
    w = agg.pivot_by_date(_pos(spark, sf_dir), ["division", "department"], FX, dates=CALENDAR)
    dcols = [c for c in w.columns if c not in ("division", "department")]
    w = w.select("division", "department", *[F.col(f"`{c}`").alias(c) for c in dcols])
    long = agg.unpivot(w, ["division", "department"], dcols, "snapshot", "fte")
    return long.select("division", "department", "snapshot", R("fte", 4).alias("fte"))


@query("topk_jobgroup", with_sql(f"""
select org, {rs('f', 4)} as fte from (
  select org, sum(fte) as f from panel_real
  where fte > 0 and org is not null and snapshot_date = (select max(snapshot_date) from panel_real where fte > 0)
  group by org) order by {rs('f', 4)} desc, org limit 10"""))
def topk_jobgroup(spark, sf_dir):
    """10 largest units by FTE at the latest snapshot (ties by name)."""
    last = agg.at_latest(_pos(spark, sf_dir), FX)
    g = last.na.drop(subset=[FX.org]).groupBy(FX.org).agg(R(F.sum(FX.weight), 4).alias("fte"))
    return g.orderBy(F.col("fte").desc(), FX.org).limit(10)


@query("top_bottom_titles", with_sql("""
select * from (select org, fte_change, 'increase' as side from c order by fte_change desc, org limit 30)
union all
select * from (select org, fte_change, 'decrease' as side from c order by fte_change asc, org limit 30)""",
    f"""bounds as (select min(snapshot_date) as d0, max(snapshot_date) as d1 from panel_real where fte > 0),
c as (select org, {rs('coalesce(sum(case when snapshot_date = (select d1 from bounds) then fte end), 0) - coalesce(sum(case when snapshot_date = (select d0 from bounds) then fte end), 0)', 4)} as fte_change
      from panel_real where fte > 0 and org is not null group by org)"""))
def top_bottom_titles(spark, sf_dir):
    """The 30 largest FTE gains and the 30 largest losses of one ordering (by unit:
    the fixture has more units than titles)."""
    c = agg.compare_snapshots(_pos(spark, sf_dir), ["org"], FX, value_cols={"fte": FX.weight}, drop_empty=False)
    return agg.head_and_tail(c.select("org", R("fte_change", 4).alias("fte_change")), "fte_change", ["org"], 30)


@query("search_capped", with_sql("""
select id, division, department, salary, (select count(*) from hits) as total_matches
from hits order by salary desc nulls last, id limit 200""", """
idx as (select * from (select *, row_number() over (partition by id
          order by snapshot_date desc, salary desc nulls last, row_id) as rn from panel) where rn = 1),
hits as (select * from idx where coalesce(contains(lower(division), 'ation_1'), false))"""))
def search_capped(spark, sf_dir):
    """Entity search over the latest record per entity, capped at 200 with the total."""
    idx = primary.entity_index(panel(spark, sf_dir), FX)
    hits = idx.where(F.coalesce(F.lower(F.col("division")).contains("ation_1"), F.lit(False)))
    total = hits.agg(F.count(F.lit(1))).scalar()                  # scalar subquery
    top = hits.orderBy(F.col("salary").desc_nulls_last(), "id").limit(200)
    return top.select("id", "division", "department", "salary", total.alias("total_matches"))


@query("distinct_pickers", with_sql("""
select distinct division, department from panel
where division is not null and department is not null"""))
def distinct_pickers(spark, sf_dir):
    """Sorted distinct (division, department) values for pickers, nulls dropped;
    a department list depends on the chosen division."""
    p = panel(spark, sf_dir)
    return (p.select("division", "department").na.drop().distinct()
             .orderBy("division", "department"))


@query("union_by_name", with_sql("""
select row_id, id, snapshot_date, salary, null::double as fte, null::varchar as title
from panel where snapshot_date < date '1998-01-01'
union all
select row_id, id, snapshot_date, null::double as salary, fte, title
from panel where snapshot_date >= date '1998-01-01'"""))
def union_by_name(spark, sf_dir):
    """G1: union of two layouts with different columns, missing ones null."""
    p = panel(spark, sf_dir)
    old = p.where(F.col(FX.date) < F.lit("1998-01-01").cast("date")).select("row_id", "id", FX.date, "salary")
    new = p.where(F.col(FX.date) >= F.lit("1998-01-01").cast("date")).select("fte", "title", "row_id", "id", FX.date)
    return old.unionByName(new, allowMissingColumns=True)
