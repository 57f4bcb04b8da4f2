"""Step 7 queries: entity index, peers, tenure, concurrent appointments,
growth in division, history with medians, roster."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import CLEAN, FIXTURE as FX
from ..functions.text import status_label
from ..operators import peers as P
from ..operators.primary import entity_index
from ..sources import fixtures
from .common import R, panel_real, raw_snapshots, regression_ctes, rs, with_sql
from .registry import REGISTRY, query

FXP = FX.with_(jobcode="title")

_IDX_SQL = """
idx as (select * from (select *, row_number() over (partition by id
          order by snapshot_date desc, salary desc nulls last, row_id) as rn from panel_real) where rn = 1)"""

_PRIM_SQL = """
prim as (select * from (select *, row_number() over (partition by id, snapshot_date
           order by salary desc nulls last, row_id) as rn from panel_real) where rn = 1)"""


@query("entity_index", with_sql("""
select id, snapshot_date, salary, snapshot_date = (select max(snapshot_date) from panel_real) as is_current,
       snapshot_date as last_seen,
       case when snapshot_date = (select max(snapshot_date) from panel_real) then 'Current'
            else 'Last seen ' || strftime(snapshot_date, '%Y-%m') end as status
from idx""", _IDX_SQL))
def entity_index_q(spark, sf_dir):
    """Latest record per entity (highest measure on the latest date), status label."""
    i = entity_index(panel_real(spark, sf_dir), FX)
    return i.select("id", FX.date, "salary", "is_current", "last_seen",
                    status_label("is_current", "last_seen").alias("status"))


@query("entity_index_lowest", with_sql("""
select id, snapshot_date, salary from (select *, row_number() over (partition by id
  order by snapshot_date desc, salary asc nulls last, row_id) as rn from panel_real) where rn = 1"""))
def entity_index_lowest(spark, sf_dir):
    """E8 as coded in the reference: lowest measure on the latest date."""
    return entity_index(panel_real(spark, sf_dir), FX, tie="lowest").select("id", FX.date, "salary")


def _peer_sql(name: str, keys: list[str]) -> str:
    on = " and ".join(f"p.{k} = i.{k}" for k in keys)
    nn = " and ".join(f"p.{k} is not null" for k in keys)
    return f"""
select i.id, '{name}' as peer_set, cast(count(*) as bigint) as peer_count,
       {rs('count(case when p.salary < i.salary then 1 end) / count(p.salary) * 100', 6)} as salary_percentile
from idx i join panel_real p on p.snapshot_date = i.snapshot_date and {on}
where {nn} and i.salary is not null
group by i.id having count(*) > 1"""


@query("peer_percentile", with_sql(" union all ".join([
    _peer_sql("department", ["org"]), _peer_sql("division_title", ["division", "title"]),
    _peer_sql("university_title", ["title"])]), _IDX_SQL))
def peer_percentile(spark, sf_dir):
    """Share of peers strictly below each entity at its last date, three peer sets."""
    p = P.peer_percentiles(panel_real(spark, sf_dir), FXP)
    return p.select("id", "peer_set", "peer_count", R("salary_percentile", 6).alias("salary_percentile"))


def _peer_stats_sql(name: str, keys: list[str]) -> str:
    on = " and ".join(f"p.{k} = i.{k}" for k in keys)
    nn = " and ".join(f"p.{k} is not null" for k in keys)
    return f"""
select i.id, '{name}' as peer_set, cast(count(*) as bigint) as peer_count,
       {rs('median(p.salary)', 6)} as salary_median, {rs('avg(p.salary)', 6)} as salary_mean
from idx i join panel_real p on p.snapshot_date = i.snapshot_date and {on}
where {nn} group by i.id having count(*) > 1"""


@query("peer_stats", with_sql(" union all ".join([
    _peer_stats_sql("department", ["org"]), _peer_stats_sql("division_title", ["division", "title"]),
    _peer_stats_sql("university_title", ["title"])]), _IDX_SQL))
def peer_stats(spark, sf_dir):
    """Median, mean and size of each entity's peer sets."""
    s = P.peer_stats(panel_real(spark, sf_dir), FXP)
    return s.select("id", "peer_set", "peer_count", R("salary_median", 6).alias("salary_median"),
                    R("salary_mean", 6).alias("salary_mean"))


def _tenure_sql() -> str:
    inner = REGISTRY["clean_panel"].sql
    return f"""
select _row_seq, id, "Date", {rs('datediff(\'day\', date_of_hire, "Date") / cast(365.25 as double)', 6)} as years_on_staff
from ({inner}) c
where date_of_hire is not null and datediff('day', date_of_hire, "Date") / cast(365.25 as double) >= 0"""


@query("tenure_years", _tenure_sql())
def tenure_years(spark, sf_dir):
    """Years on staff of every cleaned row (missing or negative dropped)."""
    t = P.tenure_years(REGISTRY["clean_panel"].build(spark, sf_dir), CLEAN)
    return t.select("_row_seq", "id", "Date", R("years_on_staff", 6).alias("years_on_staff"))


@query("concurrent_appointments", with_sql(f"""
select id, snapshot_date as last_date, cast(n as bigint) as appointments, {rs('w', 4)} as total_fte from (
  select id, snapshot_date, count(*) as n, sum(fte) as w,
         row_number() over (partition by id order by snapshot_date desc) as rn
  from panel_real group by id, snapshot_date) where rn = 1"""))
def concurrent_appointments(spark, sf_dir):
    """Rows and total weight of each entity at its last date."""
    c = P.concurrent_appointments(panel_real(spark, sf_dir), FX)
    return c.select("id", "last_date", "appointments", R("total_fte", 4).alias("total_fte"))


@query("division_growth", with_sql(f"""
select id, current_division, first_date, first_salary, current_salary,
       {rs('case when first_salary > 0 then (current_salary - first_salary) / first_salary * 100 end', 4)} as pct_growth,
       case when first_salary > 0 then current_salary - first_salary end as dollar_growth
from (select p.id, c.cd as current_division, min(p.snapshot_date) as first_date,
             arg_min(p.salary, p.snapshot_date) as first_salary, arg_max(p.salary, p.snapshot_date) as current_salary
      from prim p join cur c on p.id = c.id and p.division = c.cd group by p.id, c.cd)""",
    _PRIM_SQL + ",\ncur as (select id, arg_max(division, snapshot_date) as cd from prim group by id)"))
def division_growth(spark, sf_dir):
    """Growth while in the entity's current division."""
    g = P.growth_in_current_division(panel_real(spark, sf_dir), FX)
    return g.select("id", "current_division", "first_date", "first_salary", "current_salary",
                    R("pct_growth", 4).alias("pct_growth"), "dollar_growth")


@query("history_with_medians", with_sql(f"""
select p.id, p.snapshot_date, p.title, p.salary, {rs('p.real_salary', 4)} as real_salary,
       {rs('m.ms', 6)} as median_salary, {rs('m.mr', 6)} as median_real_salary
from prim p left join (select snapshot_date, title, median(salary) as ms, median(real_salary) as mr
                       from panel_real where title is not null group by snapshot_date, title) m
  on p.snapshot_date = m.snapshot_date and p.title = m.title""", _PRIM_SQL))
def history_with_medians(spark, sf_dir):
    """Each entity's primary history with the (date, code) medians."""
    h = P.history_with_medians(panel_real(spark, sf_dir), FXP, "title")
    return h.select("id", FX.date, "title", "salary", R("real_salary", 4).alias("real_salary"),
                    R("median_salary", 6).alias("median_salary"),
                    R("median_real_salary", 6).alias("median_real_salary"))


def _roster_sql(d: str, s: str, prim: str, extra: str = "") -> str:
    return f"""
select r.id, r.org, r.{s} as salary, g.first_salary, {rs('case when g.first_salary > 0 then (g.last_salary - g.first_salary) / g.first_salary * 100 end', 4)} as growth_pct,
       {rs('g.last_salary - g.first_salary')} as dollar_growth{extra}
from (select * from {prim} where {d} = (select max({d}) from {prim})) r
left join (select p.id, arg_min(p.{s}, p.{d}) as first_salary, arg_max(p.{s}, p.{d}) as last_salary
           from {prim} p join {prim} l on l.id = p.id and l.division = p.division
           where l.{d} = (select max({d}) from {prim}) group by p.id) g on r.id = g.id"""


@query("dept_roster", with_sql(_roster_sql("snapshot_date", "salary", "prim"), _PRIM_SQL))
def dept_roster(spark, sf_dir):
    """Latest-snapshot roster with each entity's growth inside its division."""
    r = P.department_roster(panel_real(spark, sf_dir), FX)
    return r.select("id", FX.org, "salary", "first_salary", R("growth_pct", 4).alias("growth_pct"),
                    R("dollar_growth").alias("dollar_growth"))


@query("dept_roster_tenure", f"""with c as ({REGISTRY["clean_panel"].sql}),
prim as (select *, division_department as org, current_annual_contracted_salary as salary
         from (select *, row_number() over (partition by id, "Date" order by current_annual_contracted_salary desc nulls last, _row_seq) as rn from c)
         where rn = 1)
{_roster_sql('"Date"', "salary", "prim", f""",
       {rs("datediff('day', r.date_of_hire, r." + '"Date"' + ") / cast(365.25 as double)", 6)} as years_on_staff""")}""")
def dept_roster_tenure(spark, sf_dir):
    """The roster of the cleaned panel with dollar growth and years on staff."""
    clean = REGISTRY["clean_panel"].build(spark, sf_dir)
    # the roster carries whole rows through its aggregates: only the columns it shows
    clean = clean.select(CLEAN.seq, CLEAN.id, CLEAN.date, CLEAN.division, CLEAN.org, CLEAN.measure, CLEAN.hire_date)
    r = P.department_roster(clean, CLEAN)
    return r.select("id", F.col(CLEAN.org).alias("org"), F.col(CLEAN.measure).alias("salary"), "first_salary",
                    R("growth_pct", 4).alias("growth_pct"), R("dollar_growth").alias("dollar_growth"),
                    R("years_on_staff", 6).alias("years_on_staff"))


@query("search_entities", f"""with c as ({REGISTRY["clean_panel"].sql}),
n as (select c.*, r.last_name, r.first_name from c join ({fixtures.RAW_SNAPSHOTS_SQL}) r on c._row_seq = r._row_seq),
idx as (select * from (select *, row_number() over (partition by id order by "Date" desc,
          current_annual_contracted_salary desc nulls last, _row_seq) as rn from n) where rn = 1),
hits as (select *, split_part(division_department, ' - ', 2) as department from idx
         where contains(lower(last_name), 'customer#00000') and contains(lower(first_name), 'build')
           and division = 'NATION_2' and split_part(division_department, ' - ', 2) = '1-URGENT')
select id, division, department, current_annual_contracted_salary as salary, (select count(*) from hits) as total_matches
from hits order by current_annual_contracted_salary desc nulls last, id limit 200""")
def search_entities(spark, sf_dir):
    """Search by first name, last name, division and department together, capped, with the total."""
    clean = REGISTRY["clean_panel"].build(spark, sf_dir)
    clean = clean.select("_row_seq", CLEAN.id, CLEAN.date, CLEAN.division, CLEAN.measure)
    names = raw_snapshots(spark, sf_dir).select("_row_seq", "first_name", "last_name", "department")
    index = entity_index(clean.join(names, "_row_seq"), CLEAN)
    hits = P.search_entities(index, first="BUILD", last="Customer#00000", division="NATION_2", department="1-URGENT")
    return hits.select("id", "division", "department", F.col(CLEAN.measure).alias("salary"), "total_matches")


@query("entity_history_change", with_sql(f"""
select id, first_nominal, last_nominal, {rs('first_real', 4)} as first_real, {rs('last_real', 4)} as last_real,
       case when first_nominal > 0 then last_nominal - first_nominal end as nominal_change,
       {rs('case when first_nominal > 0 then (last_nominal - first_nominal) / first_nominal * 100 end', 4)}
         as nominal_pct_change,
       {rs('case when first_real > 0 then last_real - first_real end', 4)} as real_change,
       {rs('case when first_real > 0 then (last_real - first_real) / first_real * 100 end', 4)} as real_pct_change
from (select id, arg_min(salary, snapshot_date) as first_nominal, arg_max(salary, snapshot_date) as last_nominal,
             arg_min(real_salary, snapshot_date) as first_real, arg_max(real_salary, snapshot_date) as last_real
      from prim group by id)""", _PRIM_SQL))
def entity_history_change(spark, sf_dir):
    """First-to-last nominal and real change of every entity's primary history."""
    h = P.history_change(panel_real(spark, sf_dir), FX)
    return h.select("id", "first_nominal", "last_nominal", R("first_real", 4).alias("first_real"),
                    R("last_real", 4).alias("last_real"), "nominal_change",
                    R("nominal_pct_change", 4).alias("nominal_pct_change"),
                    R("real_change", 4).alias("real_change"), R("real_pct_change", 4).alias("real_pct_change"))


def _peer_regression_sql() -> str:
    inner = REGISTRY["clean_panel"].sql
    return f"""with t as (
  select "Date" as d, division, jobcode, current_annual_contracted_salary as salary,
         datediff('day', date_of_hire, "Date") / cast(365.25 as double) as years
  from ({inner}) c),
tt as (select * from t where years is not null and years >= 0 and salary is not null
       and division is not null and jobcode is not null),
{regression_ctes("tt", ["d", "division", "jobcode"], "salary", "years")}
select d as "Date", division, jobcode, cast(n as bigint) as n, {rs('slope', 6)} as slope,
       {rs('intercept', 6)} as intercept from reg"""


@query("peer_tenure_regression", _peer_regression_sql())
def peer_tenure_regression(spark, sf_dir):
    """Salary-on-tenure line of every (date, division, job code) peer set of the cleaned panel."""
    t = P.tenure_years(REGISTRY["clean_panel"].build(spark, sf_dir), CLEAN).na.drop(subset=["division", "jobcode"])
    from ..operators.aggregate import linear_trend
    r = linear_trend(t, "current_annual_contracted_salary", "years_on_staff", ["Date", "division", "jobcode"])
    return r.select("Date", "division", "jobcode", "n", R("slope", 6).alias("slope"),
                    R("intercept", 6).alias("intercept"))


_SETS = {"department": ["division_department"], "division_title": ["division", "jobcode"], "university_title": ["jobcode"]}


def _peer_lines_sql() -> str:
    inner = REGISTRY["clean_panel"].sql
    keyed = " union all ".join(
        f"""select "Date" as d, '{n}' as peer_set, concat_ws(' | ', {", ".join(k)}) as peer_key, current_annual_contracted_salary as salary,
                   datediff('day', date_of_hire, "Date") / cast(365.25 as double) as years
            from c where {" and ".join(x + " is not null" for x in k)}""" for n, k in _SETS.items())
    return f"""with c as ({inner}), t as ({keyed}),
tt as (select * from t where years is not null and years >= 0 and salary is not null),
{regression_ctes("tt", ["d", "peer_set", "peer_key"], "salary", "years")}
select d as "Date", peer_set, peer_key, cast(n as bigint) as n, {rs('slope', 4)} as slope, {rs('intercept', 4)} as intercept from reg"""


@query("peer_lines", _peer_lines_sql())
def peer_lines(spark, sf_dir):
    """Salary-on-tenure line of every peer set, all three kinds."""
    p = P.peer_lines(REGISTRY["clean_panel"].build(spark, sf_dir), CLEAN)
    return p.select("Date", "peer_set", "peer_key", "n", R("slope", 4).alias("slope"), R("intercept", 4).alias("intercept"))


def _peer_histograms_sql() -> str:
    inner = REGISTRY["clean_panel"].sql
    keyed = " union all ".join(
        f"""select "Date" as d, '{n}' as peer_set, concat_ws(' | ', {", ".join(k)}) as peer_key, current_annual_contracted_salary as s
            from c where {" and ".join(x + " is not null" for x in k)}""" for n, k in _SETS.items())
    return f"""with c as ({inner}), t as (select * from ({keyed}) where s is not null),
r as (select d, peer_set, peer_key, min(s) as lo, max(s) as hi from t group by all)
select t.d as "Date", t.peer_set, t.peer_key,
       cast(case when hi = lo then 0 else least(floor((s - lo) / ((hi - lo) / 20)), 19) end as int) as bin, cast(count(*) as bigint) as count
from t join r on t.d = r.d and t.peer_set = r.peer_set and t.peer_key = r.peer_key group by all"""


@query("peer_histograms", _peer_histograms_sql())
def peer_histograms(spark, sf_dir):
    """Salary histogram of every peer set, all three kinds."""
    h = P.peer_histograms(REGISTRY["clean_panel"].build(spark, sf_dir), CLEAN)
    return h.select("Date", "peer_set", "peer_key", "bin", "count")
