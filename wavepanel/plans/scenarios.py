"""Step 9 queries: budget-reduction scenarios on one snapshot, plan and matching."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..operators import scenarios as S
from ..operators.matching import pipe_lines, tolerance_match
from .common import R, panel_real, rs, stored, with_sql
from .registry import query

SNAP = _dt.date(2000, 1, 1)
SC = S.Scenario(target_cost=13_000_000.0, overhead=0.30, protected_value="F",
                management_keywords=("machinery",), unit="division")
T = SC.target_salary


def _snap(spark, sf_dir):
    return panel_real(spark, sf_dir).where(F.col(FX.date) == F.lit(SNAP))


_BASE_SQL = f"""
snap as (select *, coalesce(category = 'F', false) as is_protected,
                (not coalesce(category = 'F', false)) and coalesce(contains(lower(title), 'machinery'), false)
                  as is_management
         from panel_real where snapshot_date = date '{SNAP}'),
uni as (select division, cast(count(*) as bigint) as employees,
               cast(count(case when is_protected then 1 end) as bigint) as protected,
               cast(count(case when not is_protected then 1 end) as bigint) as unprotected,
               coalesce(sum(salary), 0) as total_salary,
               coalesce(sum(case when not is_protected then salary end), 0) as unprotected_salary,
               avg(case when not is_protected then salary end) as mean_unprotected_salary,
               {T!r} / (select sum(salary) from snap) as uniform_rate
        from snap where division is not null group by division),
uc as (select *, uniform_rate * total_salary as required_cut,
              uniform_rate * total_salary / nullif(unprotected_salary, 0) * 100 as effective_pct,
              uniform_rate * total_salary / nullif(mean_unprotected_salary, 0) as est_positions
       from uni),
mf as (select * from (select *, coalesce(sum(salary) over (order by salary desc, row_id
                                 rows between unbounded preceding and 1 preceding), 0) as run
                      from snap where is_management) where run < {T!r}),
pool as (select * from snap where not is_protected and not is_management),
mp as (select division, cast(count(*) as bigint) as pool_staff, sum(salary) as pool_salary,
              {T!r} / (select sum(salary) from pool) * sum(salary) as cut_amount,
              {T!r} / (select sum(salary) from pool) * sum(salary) / avg(salary) as est_positions,
              {T!r} / (select sum(salary) from pool) * 100 as pool_pct
       from pool where division is not null group by division),
plan as (select case when salary > 200000 then 1 when salary >= 150000 then 2 else 3 end as phase,
                division as department, title, round(salary, 0) as salary, row_id as _seq from mf)"""


def _uniform(spark, sf_dir):
    return S.uniform_cut(_snap(spark, sf_dir), SC, FX)


def _mgmt_first(spark, sf_dir):
    return S.management_first(_snap(spark, sf_dir), SC, FX)


def _plan(spark, sf_dir):
    """The position plan, an input of several views: stored once per application."""
    return stored(spark, sf_dir, "position_plan", lambda: S.plan_from_cuts(_mgmt_first(spark, sf_dir), FX, "division"))


@query("uniform_cut", with_sql(f"""
select division, employees, protected, unprotected, {rs('total_salary')} as total_salary,
       {rs('unprotected_salary')} as unprotected_salary, {rs('required_cut')} as required_cut,
       {rs('effective_pct', 4)} as effective_pct, {rs('est_positions', 4)} as est_positions,
       {rs('uniform_rate * 100', 6)} as uniform_pct
from uc""", _BASE_SQL))
def uniform_cut(spark, sf_dir):
    """Uniform % cut per unit, effective % on the unprotected pool, estimated positions."""
    u = _uniform(spark, sf_dir)
    return u.select("division", "employees", "protected", "unprotected", R("total_salary").alias("total_salary"),
                    R("unprotected_salary").alias("unprotected_salary"), R("required_cut").alias("required_cut"),
                    R("effective_pct", 4).alias("effective_pct"), R("est_positions", 4).alias("est_positions"),
                    R("uniform_pct", 6).alias("uniform_pct"))


_TIER_SQL = """case when effective_pct > 15 then '1 - Severe' when effective_pct > 8 then '2 - High'
  when effective_pct > 5 then '3 - Moderate' when effective_pct > 3 then '4 - Standard' else '5 - Baseline' end"""


@query("severity_tiers", with_sql(f"""
select tier, cast(count(*) as bigint) as units, {rs('coalesce(sum(est_positions), 0)', 4)} as positions,
       {rs('sum(required_cut)')} as dollars, cast(null as double) as positions_global
from (select *, {_TIER_SQL} as tier from uc) group by tier
union all
select 'Total', cast(count(*) as bigint), {rs('coalesce(sum(est_positions), 0)', 4)}, {rs('sum(required_cut)')},
       {rs('sum(required_cut) / (select avg(salary) from snap where not is_protected)', 4)}
from uc""", _BASE_SQL))
def severity_tiers(spark, sf_dir):
    """Tiers by effective % with a total row (summed and global-ratio positions)."""
    t = S.severity_rollup(_uniform(spark, sf_dir), _snap(spark, sf_dir), SC, FX)
    return t.select("tier", "units", R("positions", 4).alias("positions"), R("dollars").alias("dollars"),
                    R("positions_global", 4).alias("positions_global"))


@query("composition_rollup", with_sql(f"""
select coalesce(class, 'All') as class, coalesce(category, 'All') as category,
       cast(count(*) as bigint) as headcount, {rs('sum(fte)', 4)} as fte, {rs('sum(salary)')} as total_salary,
       case when grouping(class) = 1 then 'grand_total' when grouping(category) = 1 then 'subtotal'
            else 'category' end as level
from (select *, case when is_protected then 'Protected' else 'Unprotected' end as class from snap where category is not null)
group by rollup(class, category)""", _BASE_SQL))
def composition_rollup(spark, sf_dir):
    """Workforce by category with subtotal and grand total."""
    c = S.composition(_snap(spark, sf_dir), SC, FX)
    return c.select("class", "category", "headcount", R("fte", 4).alias("fte"),
                    R("total_salary").alias("total_salary"), "level")


@query("management_first", with_sql("select row_id, division, title, salary from mf", _BASE_SQL))
def management_first(spark, sf_dir):
    """Management rows from the top salary down until the target is met."""
    return _mgmt_first(spark, sf_dir).select("row_id", "division", "title", "salary")


@query("management_first_by_title", with_sql(f"""
select title, cast(count(*) as bigint) as positions, {rs('sum(salary)')} as saved, {rs('avg(salary)', 6)} as avg_salary
from mf group by title""", _BASE_SQL))
def management_first_by_title(spark, sf_dir):
    """Positions cut and salary saved by title."""
    m = _mgmt_first(spark, sf_dir)
    return m.groupBy("title").agg(F.count(F.lit(1)).alias("positions"), R(F.sum("salary")).alias("saved"),
                                  R(F.avg("salary"), 6).alias("avg_salary"))


@query("management_first_by_unit", with_sql(f"""
select division, cast(count(*) as bigint) as positions, {rs('sum(salary)')} as saved
from mf group by division""", _BASE_SQL))
def management_first_by_unit(spark, sf_dir):
    """Positions cut and salary saved by unit."""
    m = _mgmt_first(spark, sf_dir)
    return m.groupBy("division").agg(F.count(F.lit(1)).alias("positions"), R(F.sum("salary")).alias("saved"))


@query("management_protected", with_sql(f"""
select division, pool_staff, {rs('pool_salary')} as pool_salary, {rs('cut_amount')} as cut_amount,
       {rs('est_positions', 4)} as est_positions, {rs('pool_pct', 6)} as pool_pct from mp""", _BASE_SQL))
def management_protected(spark, sf_dir):
    """Uniform % over the non-management unprotected pool, per unit."""
    m = S.management_protected(_snap(spark, sf_dir), SC, FX)
    return m.select("division", "pool_staff", R("pool_salary").alias("pool_salary"),
                    R("cut_amount").alias("cut_amount"), R("est_positions", 4).alias("est_positions"),
                    R("pool_pct", 6).alias("pool_pct"))


@query("scenario_compare", with_sql(f"""
select coalesce(uc.division, a.division, mp.division) as division,
       {rs('coalesce(uc.est_positions, 0)', 4)} as uniform_positions,
       coalesce(a.n, 0) as mgmt_first_positions,
       {rs('coalesce(mp.est_positions, 0)', 4)} as mgmt_protected_positions
from uc full join (select division, cast(count(*) as bigint) as n from mf group by division) a
  on uc.division = a.division
full join mp on coalesce(uc.division, a.division) = mp.division""", _BASE_SQL))
def scenario_compare(spark, sf_dir):
    """The three scenarios side by side per unit."""
    snap = _snap(spark, sf_dir)
    c = S.compare_scenarios(S.uniform_cut(snap, SC, FX), S.management_first(snap, SC, FX),
                            S.management_protected(snap, SC, FX), "division")
    return c.select("division", R("uniform_positions", 4).alias("uniform_positions"), "mgmt_first_positions",
                    R("mgmt_protected_positions", 4).alias("mgmt_protected_positions"))


_BAND_SQL = """case when salary > 200000 then '>$200K' when salary >= 150000 then '$150K-$200K'
  when salary >= 125000 then '$125K-$150K' when salary >= 100000 then '$100K-$125K'
  when salary >= 75000 then '$75K-$100K' else '<$75K' end"""


@query("salary_bands", with_sql(f"""
select coalesce(band, 'Total') as band, cast(count(*) as bigint) as headcount, {rs('sum(salary)')} as total_salary
from (select *, {_BAND_SQL} as band from snap where is_management and salary is not null) group by rollup(band)""", _BASE_SQL))
def salary_bands(spark, sf_dir):
    """Management salary bands with the total."""
    b = S.salary_bands(_snap(spark, sf_dir), SC, FX)
    return b.select("band", "headcount", R("total_salary").alias("total_salary"))


@query("management_ratio", with_sql(f"""
select division, cast(count(case when is_management then 1 end) as bigint) as management,
       cast(count(case when not is_protected then 1 end) as bigint) as unprotected,
       {rs('count(case when is_management then 1 end) / nullif(count(case when not is_protected then 1 end), 0)', 6)}
         as management_ratio
from snap where division is not null group by division""", _BASE_SQL))
def management_ratio(spark, sf_dir):
    """Management / unprotected positions per unit."""
    m = S.management_ratio(_snap(spark, sf_dir), SC, FX)
    return m.select("division", "management", "unprotected", R("management_ratio", 6).alias("management_ratio"))


@query("phase_cumulative", with_sql(f"""
select phase, positions, {rs('savings')} as savings, {rs('sum(savings) over (order by phase)')} as cumulative,
       {rs('sum(savings) over (order by phase) * 1.3')} as cumulative_with_overhead
from (select phase, cast(count(*) as bigint) as positions, sum(salary) as savings from plan group by phase)""",
    _BASE_SQL))
def phase_cumulative(spark, sf_dir):
    """Savings per phase, running total, running total with overhead."""
    p = S.phase_savings(_plan(spark, sf_dir), SC.overhead)
    return p.select("phase", "positions", R("savings").alias("savings"), R("cumulative").alias("cumulative"),
                    R("cumulative_with_overhead").alias("cumulative_with_overhead"))


@query("plan_numbering", with_sql("""
select row_number() over (order by phase, salary desc, _seq) as line, phase, department, title, salary from plan""",
    _BASE_SQL))
def plan_numbering(spark, sf_dir):
    """The plan's lines numbered in phase order."""
    return S.number_plan(_plan(spark, sf_dir)).select("line", "phase", "department", "title", "salary")


@query("untouched_units", with_sql("""
select distinct division as department from snap where division is not null
  and division not in (select department from plan)""", _BASE_SQL))
def untouched_units(spark, sf_dir):
    """Units without any line in the plan."""
    return S.untouched_units(_snap(spark, sf_dir), _plan(spark, sf_dir), "division")


@query("pipe_lines", with_sql("""
select concat_ws('|', cast(phase as varchar), department, title, cast(cast(salary as bigint) as varchar)) as value
from plan""", _BASE_SQL))
def pipe_lines_q(spark, sf_dir):
    """Plan lines as pipe-delimited text."""
    p = _plan(spark, sf_dir).withColumn("salary", F.col("salary").cast("bigint"))
    return pipe_lines(p, ["phase", "department", "title", "salary"])


@query("tolerance_match", with_sql("""
select p.line, p.phase, p.department, p.title, p.salary, t.record, r.salary as matched_salary,
       case when t.record is null then 'NO MATCH' else 'MATCH' end as status
from pl p left join took t on t.line = p.line left join snap r on r.row_id = t.record""", _BASE_SQL + """,
pl as (select row_number() over (order by phase, salary desc, _seq) as line, * from plan),
near as (select p.line, r.row_id, abs(r.salary - p.salary) as diff from pl p join snap r
           on r.division = p.department and r.title = p.title and abs(r.salary - p.salary) < 100),
rounds as (select line, row_number() over (order by line) as k from (select distinct line from near)),
-- the greedy walk: each step carries the records used so far
walk as (select 0::bigint as k, null::bigint as line, null::bigint as record, []::bigint[] as used
         union all
         select r.k, r.line, pick.row_id, case when pick.row_id is null then w.used else list_append(w.used, pick.row_id) end
         from walk w join rounds r on r.k = w.k + 1
         left join lateral (select n.row_id from near n where n.line = r.line and not list_contains(w.used, n.row_id)
                            order by n.diff, n.row_id limit 1) pick on true),
took as (select line, record from walk where record is not null)""").replace("with ", "with recursive ", 1))
def tolerance_match_q(spark, sf_dir):
    """Plan lines matched one-to-one to snapshot records within $100."""
    plan = S.number_plan(_plan(spark, sf_dir)).drop("_seq")
    m = tolerance_match(plan, _snap(spark, sf_dir), "division", "title", "salary", "row_id", 100.0)
    return m.select("line", "phase", "department", "title", "salary", "record", "matched_salary", "status")
