"""Panel-shaped views over the driver's tables (see FIXTURES.md section 2).

Each view exists twice: as a DataFrame plan (what the library runs) and as
portable SQL (what the DuckDB oracle runs).  Both read the same parquet
tables, so the work of every query grows with the data.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# --------------------------------------------------------------------------
# panel: one row per order = one appointment of customer `id` in the yearly
# snapshot of its order date.
# --------------------------------------------------------------------------


def _order_fte(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Partial (map-side) aggregation; one row per order leaves the shuffle.
    return (read_table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg((F.max("l_quantity") / F.lit(50.0)).alias("l_fte")))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation x region: 25 rows by the TPC-H spec at every scale factor, so a
    # broadcast of it is bounded.
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return F.broadcast(
        n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
         .select("n_nationkey", "n_name", "r_name"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = _geo(spark, sf_dir)
    fte = _order_fte(spark, sf_dir)
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
          .join(fte, o.o_orderkey == fte.l_orderkey, "left"))
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("id"),
        F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("snapshot_date"),
        F.col("n_name").alias("division"),
        F.col("o_orderpriority").alias("department"),
        F.col("r_name").alias("div_type"),
        F.col("c_mktsegment").alias("job_group"),
        F.col("o_orderstatus").alias("category"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("o_orderstatus")).alias("title"),
        F.coalesce(F.col("l_fte"), F.lit(0.0)).alias("fte"),
        F.col("o_totalprice").alias("salary"),
    )


PANEL_SQL = """
select o.o_orderkey as row_id, o.o_custkey as id,
       make_date(year(o.o_orderdate),1,1) as snapshot_date,
       n.n_name as division, o.o_orderpriority as department, r.r_name as div_type,
       c.c_mktsegment as job_group, o.o_orderstatus as category,
       concat(c.c_mktsegment,' ',o.o_orderstatus) as title,
       coalesce(l.fte, 0.0) as fte, o.o_totalprice as salary
from orders o join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
left join (select l_orderkey, max(l_quantity)/50.0 as fte from lineitem group by l_orderkey) l
       on l.l_orderkey = o.o_orderkey
"""

# --------------------------------------------------------------------------
# price_index: yearly deflator; 2001 is left out on purpose so that the
# fill rule of the deflation join runs.  Fixed values (FIXTURES.md 2.3).
# --------------------------------------------------------------------------
PRICE_INDEX_ROWS = [
    (1995, 1.20), (1996, 1.16), (1997, 1.12), (1998, 1.08), (1999, 1.04), (2000, 1.00),
]


PRICE_INDEX_FIRST = _dt.date(PRICE_INDEX_ROWS[0][0], 1, 1)


def price_index(spark: SparkSession) -> DataFrame:
    rows = [(_dt.date(y, 1, 1), float(v)) for y, v in PRICE_INDEX_ROWS]
    return spark.createDataFrame(rows, "d DATE, idx DOUBLE")


PRICE_INDEX_SQL = ("select d, cast(idx as double) as idx from (values "
                   + ",".join(f"(make_date({y},1,1),{v:.2f})" for y, v in PRICE_INDEX_ROWS)
                   + ") v(d, idx)")

# Panel with the deflated measures (C1 with the latest-row fill rule).
PANEL_REAL_SQL = f"""
panel as ({PANEL_SQL}),
price_index as ({PRICE_INDEX_SQL}),
latest_idx as (select idx from price_index where idx is not null order by d desc limit 1),
panel_real as (
  select p.*, p.salary * p.fte as pay,
         coalesce(pi.idx, (select idx from latest_idx)) as idx,
         p.salary * p.fte * coalesce(pi.idx, (select idx from latest_idx)) as real_pay,
         p.salary * coalesce(pi.idx, (select idx from latest_idx)) as real_salary,
         concat(p.division, ' - ', p.department) as org
  from panel p left join price_index pi on p.snapshot_date = pi.d)
"""


# --------------------------------------------------------------------------
# appointments: weekly snapshots of `events`, many rows per (user, week):
# the over-allocated groups that exercise pruning (FIXTURES.md 2.2).
# --------------------------------------------------------------------------


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("id"),
        F.to_date(F.date_trunc("week", F.col("ts"))).alias("snapshot_date"),
        F.col("event_type").alias("department"),
        (F.col("event_type") == F.lit("signup")).alias("limited"),
        F.col("value").alias("salary"),
        (F.get_json_object("props", "$.k").cast("int").cast("double") / F.lit(100)).alias("fte"),
    )


APPOINTMENTS_SQL = """
select event_id as row_id, user_id as id, cast(date_trunc('week', ts) as date) as snapshot_date,
       event_type as department, (event_type = 'signup') as limited, value as salary,
       cast(cast(json_extract_string(props,'$.k') as int) as double)/100 as fte
from events
"""

# --------------------------------------------------------------------------
# raw_snapshots: the same orders in the *raw* layout of a snapshot export
# (names, hire date, category codes, 5/6-char job codes), input of the full
# cleaning job.  Rows dated 1998 or later play the "new layout" release:
# lower-case names, so the upper-casing of the id key matters.
# --------------------------------------------------------------------------
NEW_LAYOUT_FROM = _dt.date(1998, 1, 1)


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    geo = _geo(spark, sf_dir)
    fte = _order_fte(spark, sf_dir)
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
          .join(fte, o.o_orderkey == fte.l_orderkey, "left"))
    snap = F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1))
    is_new = snap >= F.lit(NEW_LAYOUT_FROM)
    return j.select(
        F.col("o_orderkey").alias("_row_seq"),
        snap.alias("Date"),
        F.when(is_new, F.lower("c_name")).otherwise(F.col("c_name")).alias("last_name"),
        F.col("c_mktsegment").alias("first_name"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date"))
         .otherwise(F.make_date(F.lit(1990) + F.substring("o_orderpriority", 1, 1).cast("int"),
                                F.lit(1), F.lit(1))).alias("date_of_hire"),
        F.col("n_name").alias("division"),
        F.col("o_orderpriority").alias("department"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("o_orderstatus")).alias("title"),
        F.concat(F.substring("c_mktsegment", 1, 2), (F.lit(100) + F.col("c_nationkey")).cast("string"),
                 F.when(F.col("o_orderstatus") == "O", F.lit("A"))
                  .when(F.col("o_orderstatus") == "F", F.lit("Z")).otherwise(F.lit(""))).alias("jobcode"),
        F.when(F.col("o_orderstatus") == "F", F.lit("FA"))
         .when(F.col("o_orderstatus") == "O", F.lit("AS")).otherwise(F.lit("LI")).alias("employee_category"),
        F.col("o_orderstatus").alias("appt_type_length"),
        F.coalesce(F.col("l_fte"), F.lit(0.0)).alias("full_time_equivalent"),
        F.col("o_totalprice").alias("current_annual_contracted_salary"),
    )


RAW_SNAPSHOTS_SQL = f"""
select o.o_orderkey as _row_seq, make_date(year(o.o_orderdate),1,1) as "Date",
       case when make_date(year(o.o_orderdate),1,1) >= date '{NEW_LAYOUT_FROM}' then lower(c.c_name) else c.c_name end as last_name,
       c.c_mktsegment as first_name,
       case when o.o_orderstatus = 'P' then cast(null as date)
            else make_date(1990 + cast(substr(o.o_orderpriority,1,1) as int),1,1) end as date_of_hire,
       n.n_name as division, o.o_orderpriority as department,
       concat(c.c_mktsegment,' ',o.o_orderstatus) as title,
       concat(substr(c.c_mktsegment,1,2), cast(100 + c.c_nationkey as varchar),
              case when o.o_orderstatus = 'O' then 'A' when o.o_orderstatus = 'F' then 'Z' else '' end) as jobcode,
       case when o.o_orderstatus = 'F' then 'FA' when o.o_orderstatus = 'O' then 'AS' else 'LI' end as employee_category,
       o.o_orderstatus as appt_type_length,
       coalesce(l.fte, 0.0) as full_time_equivalent,
       o.o_totalprice as current_annual_contracted_salary
from orders o join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
left join (select l_orderkey, max(l_quantity)/50.0 as fte from lineitem group by l_orderkey) l
       on l.l_orderkey = o.o_orderkey
"""


def job_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job dimension keyed by the 5-char base code, derived from customer x nation.

    At most (segments x nations) rows, so bounded whatever the scale factor.
    """
    c = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    geo = _geo(spark, sf_dir)
    return (c.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.concat(F.substring("c_mktsegment", 1, 2),
                              (F.lit(100) + F.col("c_nationkey")).cast("string")).alias("jobcode"),
                     F.col("c_mktsegment").alias("job_group"),
                     F.col("r_name").alias("job_subgroup"))
             .distinct())


JOB_DIMENSION_SQL = """
select distinct concat(substr(c.c_mktsegment,1,2), cast(100 + c.c_nationkey as varchar)) as jobcode,
       c.c_mktsegment as job_group, r.r_name as job_subgroup
from customer c join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
"""
