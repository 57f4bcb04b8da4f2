"""Remaining inventory items: keyword loader, lookup classification, regex
match, pair statistics, top-k-restricted trend, the full analysis bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..functions.text import classify_lookup, matches_ci
from ..operators import aggregate as agg
from ..operators import transfers as T
from ..operators.analysis import run_full_analysis
from ..sources import fixtures
from ..sources.snapshots import probe_columns
from .common import R, panel_real, raw_snapshots, rs, with_sql
from .registry import query
from ..functions.similarity import edit_similarity
from .transfers import NO_REORG, RULES, _LAG_SQL, _tracked, reorg_sql

# Lookup of the fixture's unit types (a parameter table of the classifier).
UNIT_TYPES = {"NATION_0": "Schools & Colleges", "NATION_1": "Administration", "NATION_2": "Service Units",
              "NATION_3": "Research & Outreach", "NATION_4": "Administration"}
_UNIT_TYPES_SQL = "case " + " ".join(f"when division = '{k}' then '{v}'" for k, v in UNIT_TYPES.items()) \
    + " else 'Other' end"


@query("keyword_loader", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select first_name, last_name, department, title, current_annual_contracted_salary as salary,
       full_time_equivalent as fte,
       concat(upper(trim(coalesce(last_name, 'NAN'))), '|', upper(trim(coalesce(first_name, 'NAN')))) as name_key
from raw where coalesce(regexp_matches(division, '(?i)nation_1|nation_2'), false)""")
def keyword_loader(spark, sf_dir):
    """Columns resolved by keyword, FTE default, unit filter by regex alternation."""
    raw = raw_snapshots(spark, sf_dir)
    export = raw.select(F.col("first_name").alias("First_Name"), F.col("last_name").alias("Last_Name"),
                        F.col("division").alias("Division"), F.col("department").alias("Department"),
                        F.col("title").alias("Title"),
                        F.col("current_annual_contracted_salary").alias("Annualized_Rate_Amount"),
                        F.col("full_time_equivalent").alias("Full-Time Equivalent"))
    return probe_columns(export, "nation_1|nation_2")


@query("unit_type_lookup", with_sql(f"""
select unit_type, cast(count(distinct id) as bigint) as employees, {rs('sum(fte)', 4)} as total_fte
from (select *, {_UNIT_TYPES_SQL} as unit_type from panel_real where fte > 0
      and snapshot_date = (select max(snapshot_date) from panel_real where fte > 0))
group by unit_type"""))
def unit_type_lookup(spark, sf_dir):
    """Unit -> type through a lookup (unmatched -> Other), latest-snapshot totals by type."""
    p = agg.at_latest(panel_real(spark, sf_dir).where(F.col(FX.weight) > 0), FX)
    p = p.withColumn("unit_type", classify_lookup("division", UNIT_TYPES))
    return p.groupBy("unit_type").agg(F.count_distinct("id").alias("employees"),
                                      R(F.sum("fte"), 4).alias("total_fte"))


@query("regex_unit_match", with_sql("""
select division, cast(count(*) as bigint) as n from panel_real
where coalesce(regexp_matches(division, '(?i)^nation_(1|2)[0-4]?$'), false) group by division"""))
def regex_unit_match(spark, sf_dir):
    """Case-insensitive regex alternation on a unit name."""
    p = panel_real(spark, sf_dir).where(matches_ci("division", "^nation_(1|2)[0-4]?$"))
    return p.groupBy("division").agg(F.count(F.lit(1)).alias("n"))


@query("top_real_pairs", with_sql("""
select prev_org, org, transfer_count from (
  select prev_org, org, cast(count(*) as bigint) as transfer_count from fl
  where dept_changed and prev_org is not null and org is not null group by prev_org, org)
order by transfer_count desc, prev_org, org limit 10""", _LAG_SQL))
def top_real_pairs(spark, sf_dir):
    """The 10 largest real pairs (every move real: no similarity rule)."""
    t = _tracked(spark, sf_dir, NO_REORG)
    top = T.pair_statistics(t["pairs"])["top_real"]
    return top.select("prev_org", "org", "transfer_count")


@query("pair_stats", with_sql("""
select reorg_reason <> '' as is_reorg, cast(count(*) as bigint) as pairs, cast(sum(transfer_count) as bigint) as moves
from pairs group by 1""", reorg_sql()))
def pair_stats(spark, sf_dir):
    """Pairs and moves by re-organisation flag (similarity rules on)."""
    return T.pair_statistics(_tracked(spark, sf_dir)["pairs"])["by_flag"]


@query("top15_trend", with_sql(f"""
select p.snapshot_date, p.org, {rs('sum(p.fte)', 4)} as total_fte, {rs('sum(p.real_pay)')} as total_salary_real
from panel_real p
where p.fte > 0 and p.org in (
  select org from (select org, sum(fte) as f from panel_real
                   where fte > 0 and org is not null
                     and snapshot_date = (select max(snapshot_date) from panel_real where fte > 0)
                   group by org order by {rs('sum(fte)', 4)} desc, org limit 15))
group by p.snapshot_date, p.org"""))
def top15_trend(spark, sf_dir):
    """the 15 largest units by FTE at the latest snapshot, then their trend."""
    p = panel_real(spark, sf_dir).where(F.col(FX.weight) > 0)
    top = (agg.at_latest(p, FX).na.drop(subset=[FX.org]).groupBy(FX.org)
              .agg(R(F.sum(FX.weight), 4).alias("_f")).orderBy(F.col("_f").desc(), FX.org).limit(15)
              .select(FX.org))
    t = p.join(F.broadcast(top), FX.org, "left_semi")          # top-k: 15 rows
    return t.groupBy(FX.date, FX.org).agg(R(F.sum(FX.weight), 4).alias("total_fte"),
                                          R(F.sum("real_pay")).alias("total_salary_real"))


@query("real_pairs_with_rules", with_sql("""
select prev_org, org, transfer_count from pairs where reorg_reason = '' order by transfer_count desc, prev_org, org limit 10""",
                                         reorg_sql()))
def real_pairs_with_rules(spark, sf_dir):
    """The 10 largest real pairs with the similarity rules on."""
    top = T.pair_statistics(_tracked(spark, sf_dir)["pairs"])["top_real"]
    return top.select("prev_org", "org", "transfer_count")


_CHANGES_SQL = """
fac as (select distinct division from panel_real where category = 'F' and fte > 0.01),
ft as (select (f.division is not null) as flag, p.job_group, p.snapshot_date, sum(p.fte) as fte
       from panel_real p left join fac f on p.division = f.division where p.fte > 0.01 and p.job_group is not null group by all),
ch as (select *, fte - first_value(fte) over w as fte_change,
              (fte - first_value(fte) over w) / nullif(first_value(fte) over w, 0) * 100 as fte_pct_change
       from ft window w as (partition by flag, job_group order by snapshot_date
                            rows between unbounded preceding and unbounded following)),
recent as (select job_group, flag, avg(fte_change) as c, avg(fte_pct_change) as p from ch
           where snapshot_date >= date '1999-01-01' group by job_group, flag)"""


@query("full_analysis_bundle", with_sql(f"""
select 'salary_data' as frame, cast(count(*) as bigint) as rows, cast(count(case when is_real_transfer then 1 end) as double) as total from flags
union all select 'dept_jobgroup_prop', count(*), {rs('sum(prop)', 4)} from (
  select sum(fte) / nullif(sum(sum(fte)) over (partition by division, department, snapshot_date), 0) as prop from panel_real
  where fte > 0.01 and division is not null and department is not null and job_group is not null
  group by division, department, snapshot_date, job_group)
union all select 'dept_fte_pivot', count(distinct (division, department)), {rs('sum(fte)', 4)} from panel_real
  where fte > 0.01 and division is not null and department is not null
union all select 'fte_changes', count(*), {rs('sum(fte_change)', 4)} from ch
union all select 'fte_change_pivot', count(distinct job_group), {rs('sum(c)', 4)} from recent
union all select 'fte_pct_change_pivot', count(distinct job_group), {rs('sum(p)', 4)} from recent
union all select 'transfer_counts', count(*), cast(sum(num_real_transfers) as double) from counts
union all select 'transfer_pairs', count(*), cast(sum(transfer_count) as double) from pairs
union all select 'reorg_summary', count(distinct reorg_reason), cast(sum(transfer_count) as double) from pairs where reorg_reason <> ''
""", reorg_sql() + "," + _CHANGES_SQL))
def full_analysis_bundle(spark, sf_dir):
    """K9: the nine-frame analysis bundle; per frame its rows and the total of its measure."""
    cols = FX.with_(jobgroup="job_group")
    out = run_full_analysis(panel_real(spark, sf_dir), cols, faculty_label="F", jobgroups=["MACHINERY"],
                            min_date="1999-01-01", rules=RULES, similarity=edit_similarity)
    wide = lambda df, keys: sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in df.columns if c not in keys), F.lit(0.0))
    total = {
        "salary_data": F.col("is_real_transfer").cast("double"),
        "dept_jobgroup_prop": F.col("fte_proportion"),
        "dept_fte_pivot": wide(out["dept_fte_pivot"], ("division", "department")),
        "fte_changes": F.col("fte_change"),
        "fte_change_pivot": wide(out["fte_change_pivot"], ("job_group",)),
        "fte_pct_change_pivot": wide(out["fte_pct_change_pivot"], ("job_group",)),
        "transfer_counts": F.col("num_real_transfers"),
        "transfer_pairs": F.col("transfer_count"),
        "reorg_summary": F.col("total_employees"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), R(F.sum(total[name]), 4).alias("total")).withColumn("frame", F.lit(name))
             for name, df in out.items()]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.select("frame", "rows", "total")
