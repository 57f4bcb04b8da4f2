"""Step 2 queries: keys, recodes, hire-date fix, dedup, pruning, full cleaning job."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..columns import CLEAN, FIXTURE as FX
from ..functions import keys as K
from ..functions.lookups import CATEGORY_RECODE, MAX_TOTAL_FTE
from ..operators import clean as C
from ..operators.primary import exact_dedup
from ..sources import fixtures
from ..operators.deflate import deflate
from .common import R, appointments, panel, raw_snapshots, rs, stored, with_sql
from .registry import query

CUTOFF = _dt.date(1998, 1, 1)
# Division recode of the fixture (a parameter table: renamed unit -> kept name).
DIVISION_MAP = {"NATION_24": "NATION_2", "NATION_23": "NATION_2"}
APPT = FX.with_(id="id", date="snapshot_date", seq="row_id", weight="fte", measure="salary")


def _raw(spark, sf_dir):
    return raw_snapshots(spark, sf_dir)


def _sql_case_map(col: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"when {col} = '{k}' then '{v}'" for k, v in mapping.items())
    return f"coalesce(case {whens} end, {col})"


ID_SQL = ("substr(md5(concat(upper(coalesce(last_name,'NAN')),'|',upper(coalesce(first_name,'NAN')),'|',"
          "coalesce(substr(cast(date_of_hire as varchar),1,10),''))),1,12)")
NK_SQL = "concat(upper(trim(last_name)),'|',upper(trim(first_name)))"


def prune_sql(src: str, id_: str, date: str, seq: str, w: str, m: str, lim: str,
              limit: float = MAX_TOTAL_FTE) -> str:
    """CTEs `_g`, `_o`, `_s`, `_rec`, `pruned`: the greedy walk as a recursive CTE."""
    L = f"cast({limit} as double)"
    return f"""
_g as (select {id_} as _gid, {date} as _gd, sum({w}) as _tot from {src} group by {id_}, {date}
       having {rs('sum(' + w + ')', 9)} > {L}),
_o as (select s.*, row_number() over (partition by s.{id_}, s.{date}
          order by cast({lim} as int) desc, s.{m} desc nulls last, s.{seq}) as _prank
       from {src} s join _g on s.{id_} = _g._gid and s.{date} = _g._gd),
_s as (select _o.*, case when _prank = 1 then 0 else row_number() over (
          partition by {id_}, {date}, (_prank = 1) order by {m} desc nulls last, {seq}) end as _step from _o),
_rec as (
  select {id_} as _rid, {date} as _rd, _step, {w} as _total, {seq} as _rseq, true as _kept from _s where _step = 0
  union all
  select s.{id_}, s.{date}, s._step,
         case when r._total + s.{w} <= {L} then r._total + s.{w} else r._total end,
         s.{seq}, coalesce(r._total + s.{w} <= {L}, false)
  from _rec r join _s s on s.{id_} = r._rid and s.{date} = r._rd and s._step = r._step + 1),
pruned as (
  select x.* from {src} x left join _g on x.{id_} = _g._gid and x.{date} = _g._gd where _g._tot is null
  union all
  select x.* from {src} x join _rec on x.{seq} = _rec._rseq where _rec._kept)"""


@query("entity_id_md5", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select _row_seq, {ID_SQL} as id from raw""")
def entity_id_md5(spark, sf_dir):
    """B1: md5-based entity id from upper-cased names and hire date."""
    r = _raw(spark, sf_dir)
    return r.select("_row_seq", K.entity_id("last_name", "first_name", "date_of_hire").alias("id"))


@query("name_key", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select {NK_SQL} as name_key, cast(count(*) as bigint) as n from raw group by 1""")
def name_key(spark, sf_dir):
    """B2: normalised name key (rows per key)."""
    r = _raw(spark, sf_dir)
    return (r.select(K.name_key("last_name", "first_name").alias("name_key"))
             .groupBy("name_key").agg(F.count(F.lit(1)).alias("n")))


@query("category_recode", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select {_sql_case_map('employee_category', CATEGORY_RECODE)} as employee_category,
       cast(count(*) as bigint) as n from raw group by 1""")
def category_recode(spark, sf_dir):
    """Category codes to labels (unmatched kept)."""
    r = _raw(spark, sf_dir)
    return (r.select(K.recode("employee_category", CATEGORY_RECODE).alias("employee_category"))
             .groupBy("employee_category").agg(F.count(F.lit(1)).alias("n")))


@query("jobcode_normalize", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL})
select distinct jobcode as raw_jobcode,
       case when length(jobcode) = 6 and substr(jobcode,6,1) in ('U','A','X','N') then substr(jobcode,1,5)
            else jobcode end as jobcode,
       substr(case when length(jobcode) = 6 and substr(jobcode,6,1) in ('U','A','X','N') then substr(jobcode,1,5)
            else jobcode end, 1, 2) as "JobGroupCode"
from raw""")
def jobcode_normalize(spark, sf_dir):
    """6-char codes with a U/A/X/N suffix lose it; two-char group prefix."""
    r = _raw(spark, sf_dir)
    n = K.normalize_jobcode("jobcode")
    return (r.select(F.col("jobcode").alias("raw_jobcode"), n.alias("jobcode"),
                     K.job_group_prefix(n).alias("JobGroupCode")).distinct())


@query("hire_date_reconcile", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL}),
nk as (select *, {NK_SQL} as _nk from raw),
legacy as (select _nk, min(date_of_hire) as lh from nk where "Date" < date '{CUTOFF}' and _nk is not null
           group by _nk having count(distinct date_of_hire) = 1)
select nk._row_seq, case when nk."Date" >= date '{CUTOFF}' and l.lh is not null then l.lh
                         else nk.date_of_hire end as date_of_hire
from nk left join legacy l on nk._nk = l._nk""")
def hire_date_reconcile(spark, sf_dir):
    """Later rows take the unambiguous legacy hire date of their name."""
    r = C.reconcile_hire_dates(_raw(spark, sf_dir), CUTOFF, CLEAN)
    return r.select("_row_seq", "date_of_hire")


@query("dim_join_null_safe", f"""
with raw as ({fixtures.RAW_SNAPSHOTS_SQL}),
jobs as ({fixtures.JOB_DIMENSION_SQL}),
n as (select _row_seq, case when length(jobcode) = 6 and substr(jobcode,6,1) in ('U','A','X','N')
                       then substr(jobcode,1,5) else jobcode end as jobcode from raw)
select n._row_seq, n.jobcode, j.job_group, j.job_subgroup, j.job_group as jobgroup
from n left join jobs j on n.jobcode is not distinct from j.jobcode""")
def dim_join_null_safe(spark, sf_dir):
    """Job dimension attached with a null-safe key; jobgroup from it."""
    r = _raw(spark, sf_dir).select("_row_seq", K.normalize_jobcode("jobcode").alias("jobcode"))
    j = C.attach_job_dimension(r, fixtures.job_dimension(spark, sf_dir), CLEAN)
    return j.select("_row_seq", "jobcode", "job_group", "job_subgroup", "jobgroup")


@query("exact_dedup", f"""
with a as ({fixtures.APPOINTMENTS_SQL})
select row_id from (select row_id, row_number() over (partition by id, snapshot_date, department, fte
                                                     order by row_id) as rn from a) where rn = 1""")
def exact_dedup_q(spark, sf_dir):
    """E5: keep the first row of rows equal on the key columns (nulls equal)."""
    a = appointments(spark, sf_dir)
    return exact_dedup(a, ["id", "snapshot_date", "department", "fte"], "row_id").select("row_id")


@query("fte_total_window", f"""
with a as ({fixtures.APPOINTMENTS_SQL})
select row_id, {rs('sum(fte) over (partition by id, snapshot_date)', 6)} as total_fte from a""")
def fte_total_window(spark, sf_dir):
    """Each row gets its (id, snapshot) weight total (aggregate + join back)."""
    a = appointments(spark, sf_dir)
    t = a.groupBy("id", "snapshot_date").agg(F.sum("fte").alias("_t"))
    return a.join(t, ["id", "snapshot_date"]).select("row_id", R("_t", 6).alias("total_fte"))


@query("overallocation_prune", f"""
with recursive a as ({fixtures.APPOINTMENTS_SQL}),
{prune_sql('a', 'id', 'snapshot_date', 'row_id', 'fte', 'salary', 'coalesce(s.limited, false)')}
select row_id from pruned""")
def overallocation_prune(spark, sf_dir):
    """Greedy pruning of over-allocated (id, snapshot) groups."""
    a = appointments(spark, sf_dir)
    return C.prune_overallocated(a, APPT, limited_col="limited").select("row_id")


_CLEAN_OUT = ["_row_seq", "id", "Date", "date_of_hire", "employee_category", "jobcode", "division",
              "current_annual_contracted_salary",
              "division_department", "id_jobcode", "FullTime", "JobGroupCode", "JobNumber", "2021_Index"]
_CLEAN_MORE = ["fte_adjusted_salary", "FTE_Adjusted_Salary_2021_Dollars", "Real_Salary_2021_Dollars", "jobgroup", "job_subgroup"]


@query("clean_panel", f"""
with recursive raw as ({fixtures.RAW_SNAPSHOTS_SQL}),
price_index as ({fixtures.PRICE_INDEX_SQL}),
jobs as ({fixtures.JOB_DIMENSION_SQL}),
nk as (select *, {NK_SQL} as _nk from raw),
legacy as (select _nk, min(date_of_hire) as lh from nk where "Date" < date '{CUTOFF}' and _nk is not null
           group by _nk having count(distinct date_of_hire) = 1),
fixed as (select nk.* exclude (date_of_hire, _nk),
                 case when nk."Date" >= date '{CUTOFF}' and l.lh is not null then l.lh
                      else nk.date_of_hire end as date_of_hire
          from nk left join legacy l on nk._nk = l._nk),
ided as (select * exclude (employee_category), {ID_SQL} as id,
                {_sql_case_map('employee_category', CATEGORY_RECODE)} as employee_category from fixed),
dedup as (select * exclude (rn) from (select *, row_number() over (partition by id, "Date", title,
             current_annual_contracted_salary, full_time_equivalent, division, department
             order by _row_seq) as rn from ided) where rn = 1),
{prune_sql('dedup', 'id', '"Date"', '_row_seq', 'full_time_equivalent', 'current_annual_contracted_salary',
           "coalesce(lower(s.employee_category) like '%limited%', false)")},
norm as (select * exclude (jobcode, division),
           case when length(jobcode) = 6 and substr(jobcode,6,1) in ('U','A','X','N') then substr(jobcode,1,5)
                else jobcode end as jobcode,
           {_sql_case_map('division', DIVISION_MAP)} as division from pruned),
latest as (select idx from price_index where idx is not null order by d desc limit 1),
fin as (select n.*, concat(n.division, ' - ', n.department) as division_department,
           concat(n.id, '_', n.jobcode) as id_jobcode,
           coalesce(n.full_time_equivalent = 1, false) as "FullTime",
           substr(n.jobcode, 1, 2) as "JobGroupCode", substr(n.jobcode, 3) as "JobNumber",
           coalesce(p.idx, (select idx from latest)) as "2021_Index"
        from norm n left join price_index p on n."Date" = p.d)
select f._row_seq, f.id, f."Date", f.date_of_hire, f.employee_category, f.jobcode, f.division,
       f.current_annual_contracted_salary, f.division_department,
       f.id_jobcode, f."FullTime", f."JobGroupCode", f."JobNumber", f."2021_Index",
       {rs('f.current_annual_contracted_salary * f.full_time_equivalent', 4)} as fte_adjusted_salary,
       {rs('f.current_annual_contracted_salary * f.full_time_equivalent * f."2021_Index"', 4)} as "FTE_Adjusted_Salary_2021_Dollars",
       {rs('f.current_annual_contracted_salary * f."2021_Index"', 4)} as "Real_Salary_2021_Dollars",
       j.job_group as jobgroup, j.job_subgroup
from fin f left join jobs j on f.jobcode is not distinct from j.jobcode""")
def clean_panel(spark, sf_dir):
    """The whole cleaning job from raw snapshot rows to the panel."""
    p = stored(spark, sf_dir, "clean_panel", lambda: C.clean_panel(
        _raw(spark, sf_dir), fixtures.price_index(spark), fixtures.job_dimension(spark, sf_dir),
        hire_cutoff=CUTOFF, division_map=DIVISION_MAP, price_date="d", price_value="idx").select(*_CLEAN_OUT, *_CLEAN_MORE))
    return p.select(*_CLEAN_OUT, R("fte_adjusted_salary", 4).alias("fte_adjusted_salary"),
                    R("FTE_Adjusted_Salary_2021_Dollars", 4).alias("FTE_Adjusted_Salary_2021_Dollars"),
                    R("Real_Salary_2021_Dollars", 4).alias("Real_Salary_2021_Dollars"),
                    "jobgroup", "job_subgroup")


@query("cpi_columns", with_sql("""
select row_id, coalesce(i.cpi, (select 100 / idx from latest_idx)) as "CPI",
       coalesce(i.idx, (select idx from latest_idx)) as "CPI_2021_Index"
from panel p left join (select d, 100 / idx as cpi, idx from price_index) i on p.snapshot_date = i.d"""))
def cpi_columns(spark, sf_dir):
    """The price columns carried to the panel, misses filled with the latest month."""
    price = fixtures.price_index(spark).select("d", (F.lit(100.0) / F.col("idx")).alias("CPI"), F.col("idx").alias("CPI_2021_Index"))
    out = deflate(panel(spark, sf_dir), price, FX, idx_date="d", idx_val="CPI_2021_Index", carry=["CPI", "CPI_2021_Index"])
    return out.select("row_id", "CPI", "CPI_2021_Index")
