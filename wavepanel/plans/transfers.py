"""Step 6 queries: transfer pairs, flags, counts, re-organisation detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FIXTURE as FX
from ..functions.text import normalize_dept_name, normalize_dept_name_sql
from ..operators import transfers as T
from ..operators.clean import add_analysis_flags
from ..operators.change import previous_value
from ..sources.tables import read_table
from ..functions.similarity import edit_similarity, edit_similarity_sql
from .common import R, panel_real, rs, stored, with_sql
from .registry import query

# Every move counts as real (no similarity rule).
NO_REORG = T.ReorgRules(enabled=False)
# The fixture's unit names differ in a number and a priority word, so its rules
# are looser than the defaults; every branch of the ladder is taken.  The edit
# similarity is computed by both engines (the default is the matcher's ratio).
RULES = T.ReorgRules(similarity=0.65, min_transfers=20, mass_transfers=24, mass_similarity=0.55, rename_similarity=0.19)
FAC_GROUPS = ["MACHINERY", "BUILDING"]


def _base(spark, sf_dir):
    """K2: the panel restricted to weight > 0.01."""
    return panel_real(spark, sf_dir).where(F.col(FX.weight) > 0.01)


def _flagged(spark, sf_dir):
    """Rows with their previous unit, stored once per application (read by
    every transfer query)."""
    return stored(spark, sf_dir, "transfer_flagged",
                  lambda: previous_value(_base(spark, sf_dir), FX, FX.org))


def _tracked(spark, sf_dir, rules=None):
    """K5 results over the stored flagged rows; with the similarity rules the
    detected pair table is stored once as well."""
    flagged = _flagged(spark, sf_dir)
    if rules is not None:
        return T.track_transfers(None, FX, rules, flagged=flagged)
    pairs = stored(spark, sf_dir, "reorg_pairs",
                   lambda: T.detect_reorganizations(T.transfer_pairs(flagged, FX), FX, RULES, edit_similarity))
    return T.track_transfers(None, FX, RULES, flagged=flagged, pairs=pairs)


_LAG_SQL = """
base as (select * from panel_real where fte > 0.01),
fl as (select *, (prev_org is not null and org is distinct from prev_org) as dept_changed
       from (select *, lag(org) over (partition by id order by snapshot_date, row_id) as prev_org from base)),
movers as (select distinct id from fl where dept_changed),
counts as (select org, snapshot_date, cast(count(distinct id) as bigint) as num_real_transfers
           from fl where id in (select id from movers) and org is not null and snapshot_date is not null
           group by org, snapshot_date)"""


def _part_sql(c: str) -> str:
    return f"case when contains({c}, ' - ') then substr({c}, strpos({c}, ' - ') + 3) end"


def reorg_sql(base: str = "panel_real where fte > 0.01") -> str:
    """CTEs down to `pairs` (the rule ladder) and `flags` (rows with their flags)."""
    lag = _LAG_SQL.split("movers as")[0].replace("panel_real where fte > 0.01", base)
    norm = normalize_dept_name_sql
    return lag + f"""
tp as (select prev_org, org, cast(count(*) as bigint) as transfer_count from fl
       where dept_changed and prev_org is not null and org is not null group by prev_org, org),
tn as (select *, {norm('prev_org')} as np, {norm('org')} as nc, {norm(_part_sql('prev_org'))} as pp, {norm(_part_sql('org'))} as pc,
              contains(prev_org, ' - ') and contains(org, ' - ') as parts from tp),
ts as (select *, {edit_similarity_sql('np', 'nc')} as name_similarity, {edit_similarity_sql('pp', 'pc')} as part_similarity from tn),
pairs as (select prev_org, org, transfer_count, name_similarity,
            case when name_similarity >= {RULES.similarity} and transfer_count >= {RULES.min_transfers} then 'name_change'
                 when transfer_count >= {RULES.mass_transfers} and name_similarity >= {RULES.mass_similarity} then 'mass_restructure'
                 when parts and part_similarity >= {RULES.rename_similarity} and transfer_count >= {RULES.min_transfers}
                   then 'division_rename' else '' end as reorg_reason from ts),
moved as (select fl.*, fl.dept_changed and p.org is not null as is_reorg_transfer,
                 fl.dept_changed and p.org is null as is_real_transfer
          from fl left join pairs p on fl.prev_org = p.prev_org and fl.org = p.org and p.reorg_reason <> ''),
counts as (select org, snapshot_date, cast(count(distinct id) as bigint) as num_real_transfers from moved
           where id in (select id from moved where is_real_transfer) and org is not null and snapshot_date is not null
           group by org, snapshot_date),
flags as (select m.*, coalesce(c.num_real_transfers >= {RULES.significant}, false) as has_significant_transfers
          from moved m left join counts c on m.org = c.org and m.snapshot_date = c.snapshot_date)"""


SUMMARY_SQL = """select reorg_reason, cast(count(*) as bigint) as num_pairs, cast(sum(transfer_count) as bigint) as total_employees,
       round_even(avg(name_similarity), 2) as avg_similarity from pairs where reorg_reason <> '' group by reorg_reason"""


@query("transfer_pairs", with_sql("""
select prev_org, org, cast(count(*) as bigint) as transfer_count from fl
where dept_changed and prev_org is not null and org is not null group by prev_org, org""", _LAG_SQL))
def transfer_pairs(spark, sf_dir):
    """Moves between units from the per-entity previous row (panel with weight > 0.01)."""
    return T.transfer_pairs(_flagged(spark, sf_dir), FX)


@query("transfer_counts_ever_movers", with_sql("select * from counts", _LAG_SQL))
def transfer_counts_ever_movers(spark, sf_dir):
    """Distinct entities per (unit, date) among those who ever really moved."""
    return _tracked(spark, sf_dir, NO_REORG)["counts"]


@query("transfer_flags", with_sql("""
select fl.row_id, fl.prev_org, fl.dept_changed, false as is_reorg_transfer, fl.dept_changed as is_real_transfer,
       coalesce(c.num_real_transfers >= 10, false) as has_significant_transfers
from fl left join counts c on fl.org = c.org and fl.snapshot_date = c.snapshot_date""", _LAG_SQL))
def transfer_flags(spark, sf_dir):
    """Per-row move flags and the significant-transfers flag (>= 10)."""
    rows = _tracked(spark, sf_dir, NO_REORG)["rows"]
    return rows.select("row_id", "prev_org", "dept_changed", "is_reorg_transfer", "is_real_transfer",
                       "has_significant_transfers")


@query("reorg_detect", with_sql(f"""
select prev_org, org, transfer_count, {rs('name_similarity', 6)} as name_similarity, reorg_reason, reorg_reason <> '' as is_reorg
from pairs""", reorg_sql()))
def reorg_detect(spark, sf_dir):
    """K3: pair table with name similarity and the re-organisation rules."""
    p = _tracked(spark, sf_dir)["pairs"]
    return p.select("prev_org", "org", "transfer_count", R("name_similarity", 6).alias("name_similarity"), "reorg_reason", "is_reorg")


_UNITS_SQL = """
u as (select l_orderkey, l_linenumber, min(case when r_name = 'AFRICA' then 'AMERICA' else r_name end || ' - ' || p_type) as org
      from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
      join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey group by l_orderkey, l_linenumber),
fl as (select *, lag(org) over (partition by l_orderkey order by l_linenumber) as prev_org from u),
tp as (select prev_org, org, cast(count(*) as bigint) as transfer_count from fl
       where prev_org is not null and org is distinct from prev_org group by prev_org, org)"""
DEFAULT = T.ReorgRules()


def _ladder_sql(rules: T.ReorgRules) -> str:
    norm = normalize_dept_name_sql
    return f"""
tn as (select *, {norm('prev_org')} as np, {norm('org')} as nc, {norm(_part_sql('prev_org'))} as pp, {norm(_part_sql('org'))} as pc from tp),
ts as (select *, {edit_similarity_sql('np', 'nc')} as name_similarity, {edit_similarity_sql('pp', 'pc')} as part_similarity from tn),
pairs as (select prev_org, org, transfer_count, name_similarity,
            case when name_similarity >= {rules.similarity} and transfer_count >= {rules.min_transfers} then 'name_change'
                 when transfer_count >= {rules.mass_transfers} and name_similarity >= {rules.mass_similarity} then 'mass_restructure'
                 when part_similarity >= {rules.rename_similarity} and transfer_count >= {rules.min_transfers} then 'division_rename'
                 else '' end as reorg_reason from ts)"""


@query("reorg_default_rules", f"""
with {_UNITS_SQL}, {_ladder_sql(DEFAULT)}
select prev_org, org, transfer_count, {rs('name_similarity', 6)} as name_similarity, reorg_reason, reorg_reason <> '' as is_reorg from pairs""")
def reorg_default_rules(spark, sf_dir):
    """K3: the rule ladder at its default thresholds (0.7, 20, 100, 0.5, 0.85) over moves of orders between units
    of their lines (supplier's region, two taken together, and part's type); every branch of the ladder is taken at sf0.01."""
    t = lambda name: read_table(spark, sf_dir, name)
    # nation x region: 25 rows by the specification
    geo = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    lines = (t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
             .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
             .groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias(FX.seq))
             .agg(F.min(F.concat(F.replace("r_name", F.lit("AFRICA"), F.lit("AMERICA")), F.lit(" - "), F.col("p_type"))).alias(FX.org))
             .withColumn(FX.date, F.lit("2000-01-01").cast("date")))
    pairs = T.transfer_pairs(previous_value(lines, FX, FX.org), FX)
    p = T.detect_reorganizations(pairs, FX, DEFAULT, edit_similarity)
    return p.select(f"prev_{FX.org}", FX.org, "transfer_count", R("name_similarity", 6).alias("name_similarity"), "reorg_reason", "is_reorg")


@query("reorg_summary", with_sql(SUMMARY_SQL, reorg_sql()))
def reorg_summary(spark, sf_dir):
    """Re-organisation pairs by reason: count, moves, mean similarity."""
    return _tracked(spark, sf_dir)["summary"]


@query("reorg_mapping", with_sql("""
select prev_org, min(org) as new_org from pairs where reorg_reason <> '' group by prev_org""", reorg_sql()))
def reorg_mapping(spark, sf_dir):
    """K4: old unit -> new unit, first in key order."""
    return T.reorg_mapping(_tracked(spark, sf_dir)["pairs"], FX)


@query("reorg_flags", with_sql("""
select row_id, prev_org, dept_changed, is_reorg_transfer, is_real_transfer, has_significant_transfers,
       dept_changed as transferred, has_significant_transfers as "DeptHas4PlusTransfers" from flags""", reorg_sql()))
def reorg_flags(spark, sf_dir):
    """Per-row flags with the similarity rules switched on."""
    rows = _tracked(spark, sf_dir)["rows"]
    return rows.select("row_id", "prev_org", "dept_changed", "is_reorg_transfer", "is_real_transfer",
                       "has_significant_transfers", "transferred", "DeptHas4PlusTransfers")


@query("dept_name_normalize", f"""
select distinct concat(p_type, ' - ', p_name) as name,
       {normalize_dept_name_sql("concat(p_type, ' - ', p_name)")} as normalized from part""")
def dept_name_normalize(spark, sf_dir):
    """Name normalisation for similarity: abbreviations, punctuation, whitespace."""
    p = read_table(spark, sf_dir, "part")
    name = F.concat(F.col("p_type"), F.lit(" - "), F.col("p_name"))
    return p.select(name.alias("name"), normalize_dept_name(name).alias("normalized")).distinct()


@query("analysis_flags", with_sql(f"""
select p.row_id, (f.division is not null) as "IsFacultyDivision",
       coalesce(p.job_group in ({", ".join(repr(g) for g in FAC_GROUPS)}), false) as "IsFacResTeachingTitle"
from panel_real p left join (select distinct division from panel_real where category = 'P') f
  on p.division = f.division"""))
def analysis_flags(spark, sf_dir):
    """Unit has any row of the given category; job group in the given list."""
    f = add_analysis_flags(panel_real(spark, sf_dir), FX, faculty_label="P", jobgroups=FAC_GROUPS)
    return f.select("row_id", "IsFacultyDivision", "IsFacResTeachingTitle")
