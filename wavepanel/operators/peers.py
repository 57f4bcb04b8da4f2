"""Entity views for every entity at once.

The reference computes these for one person per page view; here each is a
set-based job over all entities, so a view is then a key filter on the
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..functions.numeric import pct_change
from ..functions.text import contains_ci
from .aggregate import exact_quantiles_of, histogram, linear_trend, pick_quantiles, ranked_values
from .primary import entity_index, primary_rows

PEER_SETS = {
    "department": lambda c: [c.org],
    "division_title": lambda c: [c.division, c.jobcode],
    "university_title": lambda c: [c.jobcode],
}


PEER_KEYS = ["peer_set", "peer_date", "_k1", "_k2"]


def in_peer_sets(df: DataFrame, cols: PanelCols, sets: dict | None, *carry: str) -> DataFrame:
    """Every row once per peer set it belongs to, in one pass: (peer_set,
    peer_date, _k1, _k2, carried columns).  Sets have one or two keys; rows
    without one of a set's keys are not in it."""
    entries = []
    for name, keyf in (sets or PEER_SETS).items():
        keys = [F.col(k).cast("string") for k in keyf(cols)]
        if len(keys) > 2:
            raise ValueError(f"peer set {name}: at most two keys")
        entries.append(F.struct(F.lit(name).alias("s"), keys[0].alias("a"), (keys[1] if len(keys) > 1 else F.lit("")).alias("b")))
    return (df.select(F.col(cols.date).alias("peer_date"), *carry, F.explode(F.array(*entries)).alias("_e"))
            .select(F.col("_e.s").alias("peer_set"), "peer_date", F.col("_e.a").alias("_k1"), F.col("_e.b").alias("_k2"), *carry)
            .where(F.col("_k1").isNotNull() & F.col("_k2").isNotNull()))


def peer_ranks(df: DataFrame, cols: PanelCols = CLEAN, sets: dict | None = None) -> DataFrame:
    """For each (peer set, date, keys, measure value): rows strictly below it, the
    number of non-null values and the peer-set size, for all peer sets at once
    (`ranked_values`: a peer set of any size is split)."""
    ranked = ranked_values(in_peer_sets(df, cols, sets, cols.measure), PEER_KEYS, cols.measure)
    return ranked.select(*PEER_KEYS, cols.measure, F.col("_before").alias("lower"), F.col("_n").alias("n_values"), F.col("_rows").alias("peer_count"))


def peer_percentiles(df: DataFrame, cols: PanelCols = CLEAN, sets: dict | None = None,
                     tie: str = "highest") -> DataFrame:
    """Each entity's percentile (share of peers strictly lower x 100) at
    its own last date, in each peer set with more than one row."""
    own = in_peer_sets(entity_index(df, cols, tie), cols, sets, cols.id, cols.measure)
    return (own.join(peer_ranks(df, cols, sets).where(F.col("peer_count") > 1), [*PEER_KEYS, cols.measure])
            .select(cols.id, "peer_set", "peer_count", (F.col("lower") / F.col("n_values") * F.lit(100.0)).alias("salary_percentile")))


def peer_stats(df: DataFrame, cols: PanelCols = CLEAN, sets: dict | None = None,
               tie: str = "highest") -> DataFrame:
    """Median, mean and size of each entity's peer sets at its last date
    (exact medians, all sets in one pass: a peer set may be a hot group)."""
    m = cols.measure
    ranked = ranked_values(in_peer_sets(df, cols, sets, m), PEER_KEYS, m).where(F.col("_rows") > 1)
    stats = pick_quantiles(ranked, PEER_KEYS, m, (0.5,), [
        F.max("_rows").alias("peer_count"), F.try_divide(F.sum(F.col(m) * F.col("_c")), F.max("_n")).alias("salary_mean")])
    own = in_peer_sets(entity_index(df, cols, tie), cols, sets, cols.id)
    return (own.join(stats, PEER_KEYS)
            .select(cols.id, "peer_set", "peer_count", F.col("p50").alias("salary_median"), "salary_mean"))


def peer_lines(df: DataFrame, cols: PanelCols = CLEAN, sets: dict | None = None) -> DataFrame:
    """The salary-on-tenure line of every peer set of every date, for
    each kind of set: (peer_set, key, date, n, slope, intercept)."""
    t = tenure_years(df, cols)
    return _per_set(t, cols, sets, lambda x, keys: linear_trend(x, cols.measure, "years_on_staff", [cols.date, *keys]))


def peer_histograms(df: DataFrame, cols: PanelCols = CLEAN, sets: dict | None = None, bins: int = 20) -> DataFrame:
    """The salary histogram of every peer set of every date, for each
    kind of set: (peer_set, key, date, bin, count, bin_low, bin_high)."""
    return _per_set(df, cols, sets, lambda x, keys: histogram(x, cols.measure, bins, [cols.date, *keys]))


def _per_set(df: DataFrame, cols: PanelCols, sets: dict | None, fn) -> DataFrame:
    out = None
    for name, keyf in (sets or PEER_SETS).items():
        keys = keyf(cols)
        one = fn(df.na.drop(subset=[cols.date, *keys]), keys)
        one = one.select(F.lit(name).alias("peer_set"), F.concat_ws(" | ", *keys).alias("peer_key"), *[c for c in one.columns if c not in keys])
        out = one if out is None else out.unionByName(one)
    return out


def tenure_years(df: DataFrame, cols: PanelCols = CLEAN, at: str | None = None) -> DataFrame:
    """Years between hire date and the row's date (days / 365.25);
    rows with a missing or negative tenure are dropped."""
    at = at or cols.date
    t = df.withColumn("years_on_staff", F.datediff(F.col(at), F.col(cols.hire_date)) / F.lit(365.25))
    return t.where(F.col("years_on_staff").isNotNull() & (F.col("years_on_staff") >= 0))


def concurrent_appointments(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """Number of rows and total weight of each entity at its last date."""
    g = df.groupBy(cols.id, cols.date).agg(F.count(F.lit(1)).alias("n"), F.sum(cols.weight).alias("w"))
    last = g.groupBy(cols.id).agg(F.max_by(F.struct("n", "w", F.col(cols.date).alias("d")),
                                           F.col(cols.date)).alias("_l"))
    return last.select(cols.id, F.col("_l.d").alias("last_date"), F.col("_l.n").alias("appointments"),
                       F.col("_l.w").alias("total_fte"))


def growth_in_current_division(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """First and latest primary measure while in the entity's current
    division, with growth (null when the first value is not positive)."""
    prim = primary_rows(df, cols)
    # a window over primary rows: one per snapshot and entity
    inside = (prim.withColumn("_cd", F.max_by(cols.division, cols.date).over(Window.partitionBy(cols.id)))
              .where(F.col(cols.division) == F.col("_cd")))
    g = inside.groupBy(cols.id, F.col("_cd").alias("current_division")).agg(
        F.min(cols.date).alias("first_date"),
        F.min_by(cols.measure, cols.date).alias("first_salary"),
        F.max_by(cols.measure, cols.date).alias("current_salary"))
    ok = F.col("first_salary") > 0
    return (g.withColumn("pct_growth", F.when(ok, pct_change("current_salary", "first_salary")))
             .withColumn("dollar_growth", F.when(ok, F.col("current_salary") - F.col("first_salary"))))


def history_with_medians(df: DataFrame, cols: PanelCols = CLEAN, code: str | None = None) -> DataFrame:
    """Each entity's primary row per date with the (date, code)
    medians of the nominal and real measure (exact, distributed quantiles).
    The median table has one row per (date, code); AQE broadcasts it when
    small."""
    code = code or cols.jobcode
    base = df.na.drop(subset=[code])
    g = [cols.date, code]
    med = exact_quantiles_of(base, g, {cols.measure: "median_salary", cols.real_measure: "median_real_salary"})
    prim = primary_rows(df, cols).select(cols.id, cols.date, code, cols.measure, cols.real_measure)
    return prim.join(med, [cols.date, code], "left")


def department_roster(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """Primary rows of the latest snapshot with each entity's growth in
    percent and money from its first to its last primary record *in the
    division of its roster row*, and (with a hire date) its years on staff at
    the latest snapshot, negative ones included."""
    prim = primary_rows(df, cols)
    latest = prim.agg(F.max(cols.date)).scalar()
    roster = prim.where(F.col(cols.date) == latest)
    if cols.hire_date in df.columns:
        roster = roster.withColumn("years_on_staff", F.datediff(latest, F.col(cols.hire_date)) / F.lit(365.25))
    here = prim.join(roster.select(F.col(cols.id).alias("_id"), F.col(cols.division).alias("_div")),
                     (F.col(cols.id) == F.col("_id")) & (F.col(cols.division) == F.col("_div")), "left_semi")
    growth = here.groupBy(cols.id).agg(F.min_by(cols.measure, cols.date).alias("first_salary"),
                                       F.max_by(cols.measure, cols.date).alias("last_salary"))
    g = (growth.withColumn("growth_pct", F.when(F.col("first_salary") > 0, pct_change("last_salary", "first_salary")))
               .withColumn("dollar_growth", F.col("last_salary") - F.col("first_salary")))
    return roster.join(g, cols.id, "left")


def search_entities(index: DataFrame, first: str | None = None, last: str | None = None, division: str | None = None,
                    department: str | None = None, cols: PanelCols = CLEAN, limit: int = 200,
                    first_col: str = "first_name", last_col: str = "last_name") -> DataFrame:
    """The entity index filtered by any of first and last name
    (contains, ignoring case), division and department (equal), the largest
    measures first (ties by id), at most `limit` rows, with the total number
    of matches.  Without any filter there is no result."""
    if not (first or last or division or department):
        return index.withColumn("total_matches", F.lit(0).cast("bigint")).limit(0)
    hits = index
    for needle, col in ((first, first_col), (last, last_col)):
        if needle:
            hits = hits.where(contains_ci(col, needle))
    for value, col in ((division, cols.division), (department, cols.department)):
        if value:
            hits = hits.where(F.col(col) == F.lit(value))
    total = hits.agg(F.count(F.lit(1))).scalar()                  # scalar subquery
    return hits.orderBy(F.col(cols.measure).desc_nulls_last(), cols.id).limit(limit).withColumn("total_matches", total)


def history_change(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """Each entity's first and last primary measure, nominal and real,
    with the change and % change (only when the first value is positive)."""
    prim = primary_rows(df, cols)
    g = prim.groupBy(cols.id).agg(
        F.min_by(cols.measure, cols.date).alias("first_nominal"),
        F.max_by(cols.measure, cols.date).alias("last_nominal"),
        F.min_by(cols.real_measure, cols.date).alias("first_real"),
        F.max_by(cols.real_measure, cols.date).alias("last_real"))
    out = g
    for k in ("nominal", "real"):
        f, l_ = F.col(f"first_{k}"), F.col(f"last_{k}")
        out = (out.withColumn(f"{k}_change", F.when(f > 0, l_ - f))
                  .withColumn(f"{k}_pct_change", F.when(f > 0, pct_change(f"last_{k}", f"first_{k}"))))
    return out
