"""Step 8 queries: keyword classification, consolidation cohort, job-function
before/after (by function, title and location)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..functions.text import keyword_category, keyword_category_sql
from ..operators import cohort as CO
from ..operators.aggregate import exact_quantiles, exact_quantiles_of
from ..sources import fixtures
from ..sources.tables import read_table
from .common import R, panel_real, rs, with_sql
from .registry import query

START, END = _dt.date(1996, 1, 1), _dt.date(2000, 1, 1)
ADMIN = ["1-URGENT", "2-HIGH"]
# Keyword tables of the fixture (parameters of the operator, in priority order).
TITLE_KEYWORDS = [("Leadership", ["building f"]), ("Finance", ["machinery", "automobile o"]),
                  ("IT", ["household"]), ("Dept Admin", ["automobile"])]
PART_KEYWORDS = [("Small", ["small"]), ("Colour", ["red", "blue", "green"]),
                 ("Fastener", ["bolt", "nut", "screw"]), ("Mechanism", ["gear", "widget"])]
_ADMIN_SQL = ", ".join(f"'{u}'" for u in ADMIN)


def _cohort(spark, sf_dir):
    return CO.cohort_moves(panel_real(spark, sf_dir), START, END, ADMIN, TITLE_KEYWORDS, FX)


_COHORT_SQL = f"""
pos as (select * from panel_real where salary > 0 and fte > 0),
s as (select * from (select *, row_number() over (partition by id order by salary desc nulls last, row_id) as rn
      from pos where snapshot_date = date '{START}') where rn = 1),
e as (select * from (select *, row_number() over (partition by id order by salary desc nulls last, row_id) as rn
      from pos where snapshot_date = date '{END}' and department in ({_ADMIN_SQL})) where rn = 1),
m as (select e.id, s.department as department_start, e.department as department_end,
        s.title as title_start, e.title as title_end, s.salary as salary_start, e.salary as salary_end,
        s.fte as fte_start, e.fte as fte_end,
        case when coalesce(s.department in ({_ADMIN_SQL}), false) then '{CO.ORIGINAL}' else '{CO.MOVED}' end as "group",
        e.salary - s.salary as salary_change, (e.salary - s.salary) / s.salary * 100 as pct_change,
        {keyword_category_sql('e.title', TITLE_KEYWORDS)} as category,
        case when not coalesce(s.department in ({_ADMIN_SQL}), false) then s.department
             else 'Administration' end as source_dept
      from e join s on e.id = s.id)"""


@query("keyword_category", f"""
select distinct p_name, {keyword_category_sql('p_name', PART_KEYWORDS)} as category from part""")
def keyword_category_q(spark, sf_dir):
    """First matching category in priority order (case-insensitive substring)."""
    p = read_table(spark, sf_dir, "part")
    return p.select("p_name", keyword_category("p_name", PART_KEYWORDS).alias("category")).distinct()


@query("cohort_two_group", with_sql(f"""
select "group", cast(count(*) as bigint) as n, {rs('median(salary_start)', 6)} as median_start,
       {rs('median(salary_end)', 6)} as median_end, {rs('median(pct_change)', 4)} as median_pct,
       {rs('avg(pct_change)', 4)} as mean_pct, {rs('quantile_cont(pct_change, 0.25)', 4)} as pct_25,
       {rs('quantile_cont(pct_change, 0.75)', 4)} as pct_75
from m group by "group\"""", _COHORT_SQL))
def cohort_two_group(spark, sf_dir):
    """Two-group pay comparison (moved vs originally in the admin units)."""
    g = CO.group_summary(_cohort(spark, sf_dir)["merged"], ["group"])
    return g.select("group", "n", R("median_start", 6).alias("median_start"), R("median_end", 6).alias("median_end"),
                    *[R(c, 4).alias(c) for c in ("median_pct", "mean_pct", "pct_25", "pct_75")])


@query("cohort_by_function", with_sql(f"""
select category, "group", cast(count(*) as bigint) as n, {rs('median(salary_start)', 6)} as median_start,
       {rs('median(salary_end)', 6)} as median_end, {rs('median(pct_change)', 4)} as median_pct,
       {rs('avg(pct_change)', 4)} as mean_pct
from m group by category, "group\"""", _COHORT_SQL))
def cohort_by_function(spark, sf_dir):
    """The comparison by job function x group."""
    g = CO.group_summary(_cohort(spark, sf_dir)["merged"], ["category", "group"], quartiles=False)
    return g.select("category", "group", "n", R("median_start", 6).alias("median_start"),
                    R("median_end", 6).alias("median_end"), R("median_pct", 4).alias("median_pct"),
                    R("mean_pct", 4).alias("mean_pct"))


@query("first_move_date", with_sql(f"""
select move_date, cast(count(*) as bigint) as n, {rs('median(pct_change)', 4)} as median_pct,
       {rs('avg(pct_change)', 4)} as mean_pct
from (select m.*, strftime(f.md, '%Y-%m') as move_date from m
      join (select id, min(snapshot_date) as md from panel_real
            where department in ({_ADMIN_SQL}) and snapshot_date >= date '{START}'
              and id in (select id from m where "group" = '{CO.MOVED}') group by id) f on m.id = f.id
      where m."group" = '{CO.MOVED}')
group by move_date""", _COHORT_SQL))
def first_move_date(spark, sf_dir):
    """When moved people first appear in the admin units; raises by move date."""
    c = _cohort(spark, sf_dir)
    m = CO.first_move_dates(panel_real(spark, sf_dir), c["merged"], ADMIN, FX, since=START)
    mv = m.where(F.col("group") == CO.MOVED)
    g = (mv.groupBy("move_date").agg(F.count(F.lit(1)).alias("n"), F.avg("pct_change").alias("b"))
           .join(exact_quantiles(mv, ["move_date"], "pct_change").withColumnRenamed("p50", "a"),
                 ["move_date"]))
    return g.select("move_date", "n", R("a", 4).alias("median_pct"), R("b", 4).alias("mean_pct"))


@query("source_dept_summary", with_sql(f"""
select source_dept, cast(count(*) as bigint) as n, {rs('median(pct_change)', 4)} as median_pct,
       {rs('median(salary_start)', 6)} as median_start, {rs('median(salary_end)', 6)} as median_end
from m where "group" = '{CO.MOVED}' group by source_dept""", _COHORT_SQL))
def source_dept_summary(spark, sf_dir):
    """Moved people by source unit."""
    m = _cohort(spark, sf_dir)["merged"].where(F.col("group") == CO.MOVED)
    k = ["source_dept"]
    g = (m.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
          .join(exact_quantiles_of(m, k, {"pct_change": "a", "salary_start": "b", "salary_end": "c"}), k, "left"))
    return g.select("source_dept", "n", R("a", 4).alias("median_pct"), R("b", 6).alias("median_start"),
                    R("c", 6).alias("median_end"))


@query("cohort_detail_with_new", with_sql(f"""
select id, "group", category, title_start, title_end, source_dept, fte_start, fte_end, salary_start, salary_end,
       {rs('salary_change')} as salary_change, {rs('pct_change', 4)} as pct_change from m
union all
select e.id, '{CO.NEW}' as "group", {keyword_category_sql('e.title', TITLE_KEYWORDS)} as category,
       null as title_start, e.title as title_end, null as source_dept, null as fte_start, e.fte as fte_end,
       null as salary_start, e.salary as salary_end, null as salary_change, null as pct_change
from e where e.id not in (select id from m)""", _COHORT_SQL))
def cohort_detail_with_new(spark, sf_dir):
    """Comparison rows plus current admin people not present at the start."""
    c = _cohort(spark, sf_dir)
    d = CO.detail_with_new(c["merged"], c["end_admin"], TITLE_KEYWORDS, FX)
    return d.select("id", "group", "category", "title_start", "title_end", "source_dept", "fte_start", "fte_end",
                    "salary_start", "salary_end", R("salary_change").alias("salary_change"),
                    R("pct_change", 4).alias("pct_change"))


@query("cohort_size_guard", with_sql("""
select category, o, a from (
  select category, cast(count(case when "group" = 'Administration (original)' then 1 end) as bigint) as o,
         cast(count(case when "group" = 'Moved (from departments)' then 1 end) as bigint) as a
  from m group by category) where least(o, a) >= 3""", _COHORT_SQL))
def cohort_size_guard(spark, sf_dir):
    """Job functions with at least 3 people in each group (missing group = 0)."""
    m = _cohort(spark, sf_dir)["merged"]
    w = m.groupBy("category").pivot("group", [CO.ORIGINAL, CO.MOVED]).agg(F.count(F.lit(1))).na.fill(0)
    w = w.select("category", F.col(f"`{CO.ORIGINAL}`").alias("o"), F.col(f"`{CO.MOVED}`").alias("a"))
    return w.where(F.least("o", "a") >= 3)


def _factor(spark):
    return CO.price_factor(fixtures.price_index(spark), START, "d", "idx")


_FACTOR_SQL = f"""
factor as (select (select idx from price_index where d = date '{START}')
                / (select idx from price_index where idx is not null order by d desc limit 1) as f),
fx as (select p.* exclude (category), {keyword_category_sql('p.title', TITLE_KEYWORDS)} as category,
              p.snapshot_date = date '{START}' as is_start,
              p.salary * p.fte * case when p.snapshot_date = date '{START}' then (select f from factor) else 1.0 end
                as total_pay,
              case when coalesce(p.department in ({_ADMIN_SQL}), false) then 'Administration'
                   else 'Departments' end as location
       from panel_real p where p.fte > 0 and p.snapshot_date in (date '{START}', date '{END}')),
fa as (select * from fx where category <> 'Other')"""


@query("function_fte_compare", with_sql(f"""
select category, {rs('fs', 4)} as fte_start, {rs('fe', 4)} as fte_end, {rs('ps')} as pay_start,
       {rs('pe', 4)} as pay_end, {rs('fe - fs', 4)} as fte_change, {rs('pe - ps')} as pay_change,
       {rs('(fe - fs) / nullif(fs, 0) * 100', 4)} as fte_pct_change,
       {rs('(pe - ps) / nullif(ps, 0) * 100', 4)} as pay_pct_change
from (select category, fs, fe, ps, pe from g
      union all select 'TOTAL', sum(fs), sum(fe), sum(ps), sum(pe) from g)""", _FACTOR_SQL + """,
g as (select category,
        coalesce(sum(case when is_start then fte end), 0) as fs, coalesce(sum(case when not is_start then fte end), 0) as fe,
        coalesce(sum(case when is_start then total_pay end), 0) as ps,
        coalesce(sum(case when not is_start then total_pay end), 0) as pe
      from fa group by category)"""))
def function_fte_compare(spark, sf_dir):
    """FTE and pay per job function at two dates, start pay in end prices, TOTAL."""
    f = CO.function_compare(panel_real(spark, sf_dir), START, END, TITLE_KEYWORDS, _factor(spark), FX)
    return f.select("category", R("fte_start", 4).alias("fte_start"), R("fte_end", 4).alias("fte_end"),
                    R("pay_start").alias("pay_start"), R("pay_end", 4).alias("pay_end"),
                    R("fte_change", 4).alias("fte_change"), R("pay_change").alias("pay_change"),
                    R("fte_pct_change", 4).alias("fte_pct_change"), R("pay_pct_change", 4).alias("pay_pct_change"))


@query("function_title_change", with_sql(f"""
select category, title, {rs('fs', 4)} as fte_start, ns as n_start, {rs('ps')} as pay_start,
       {rs('fe', 4)} as fte_end, ne as n_end, {rs('pe', 4)} as pay_end, {rs('fe - fs', 4)} as fte_change,
       {rs('pe - ps')} as pay_change
from (select category, title,
        coalesce(sum(case when is_start then fte end), 0) as fs,
        cast(count(case when is_start then 1 end) as bigint) as ns,
        coalesce(sum(case when is_start then total_pay end), 0) as ps,
        coalesce(sum(case when not is_start then fte end), 0) as fe,
        cast(count(case when not is_start then 1 end) as bigint) as ne,
        coalesce(sum(case when not is_start then total_pay end), 0) as pe
      from fa group by category, title)""", _FACTOR_SQL))
def function_title_change(spark, sf_dir):
    """(function, title) FTE, count and pay at both dates (missing = 0)."""
    f = CO.function_by_title(panel_real(spark, sf_dir), START, END, TITLE_KEYWORDS, _factor(spark), FX)
    return f.select("category", "title", R("fte_start", 4).alias("fte_start"), "n_start",
                    R("pay_start").alias("pay_start"), R("fte_end", 4).alias("fte_end"), "n_end",
                    R("pay_end", 4).alias("pay_end"), R("fte_change", 4).alias("fte_change"),
                    R("pay_change").alias("pay_change"))


def _digits(side: str, m: str) -> int:
    """Rounding digits: FTE and end-date pay (salary x FTE) have 4 exact decimals;
    start-date pay is deflated (many decimals) and is rounded to cents."""
    return 4 if m == "fte" or side == "end" else 2


_LOC_VALS = [(side, m, loc) for side in ("start", "end") for m in ("fte", "pay") for loc in ("admin", "depts")]


def _loc_sum(side, m, loc):
    cond = ("is_start" if side == "start" else "not is_start") + \
        (" and location = 'Administration'" if loc == "admin" else " and location = 'Departments'")
    col = "fte" if m == "fte" else "total_pay"
    return f"coalesce(sum(case when {cond} then {col} end), 0) as {side}_{m}_{loc}"


@query("function_by_location", with_sql(
    "select category, " + ", ".join(
        [f"{rs(f'{s}_{m}_{loc}', _digits(s, m))} as {s}_{m}_{loc}" for s, m, loc in _LOC_VALS]
        + [f"{rs(f'{s}_{m}_admin + {s}_{m}_depts', _digits(s, m))} as {s}_{m}_total"
           for s in ('start', 'end') for m in ('fte', 'pay')]
        + [f"{rs('(end_fte_admin + end_fte_depts) - (start_fte_admin + start_fte_depts)', 4)} as fte_net_change",
           f"{rs('(end_pay_admin + end_pay_depts) - (start_pay_admin + start_pay_depts)')} as pay_net_change"])
    + " from (select * from g union all select 'TOTAL', "
    + ", ".join(f"sum({s}_{m}_{loc})" for s, m, loc in _LOC_VALS) + " from g)",
    _FACTOR_SQL + ",\ng as (select category, " + ", ".join(_loc_sum(*v) for v in _LOC_VALS)
    + " from fa group by category)"))
def function_by_location(spark, sf_dir):
    """Function x location at both dates, totals and net change."""
    f = CO.function_by_location(panel_real(spark, sf_dir), START, END, TITLE_KEYWORDS, _factor(spark), ADMIN, FX)
    out = ["category"]
    for c in f.columns:
        if c == "category":
            continue
        side, m = (c.split("_")[0], c.split("_")[1]) if c.startswith(("start_", "end_")) else ("", "pay")
        out.append(R(c, 4 if "fte" in c else _digits(side, m)).alias(c))
    return f.select(*out)
