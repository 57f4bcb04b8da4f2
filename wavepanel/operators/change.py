"""Changes over time: previous unit, baselines, consecutive-snapshot pairs,
first-vs-last comparisons, sub-period growth (E1-E3, C8-C11, D35-D36,
K8, K15-K18, K20).

The snapshot calendar (distinct dates) is bounded by the number of
snapshots, so it is broadcast; per-entity windows run over *primary rows*
(one per entity and snapshot), so a window partition never holds more than
one row per snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..functions.numeric import pct_change, safe_div
from .primary import primary_rows


def calendar(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """Distinct snapshot dates with their ordinal `snap_idx` (0-based).

    One row per snapshot; the single ordered window runs over that tiny set.
    """
    d = df.select(F.col(cols.date)).where(F.col(cols.date).isNotNull()).distinct()
    return d.withColumn("snap_idx", F.row_number().over(Window.orderBy(cols.date)) - 1)


def previous_value(df: DataFrame, cols: PanelCols = CLEAN, value: str | None = None,
                   per: str = "row", bucket_rows: int = 1 << 20) -> DataFrame:
    """Value of the entity's previous row (date, then row order).

    per="row" reproduces the reference: two same-day rows of one entity form
    a move.  It is computed as a two-level lag so that no window partition
    holds more than `bucket_rows` rows, whatever the size of one entity:
    (1) a lag inside (entity, date, row bucket), where the row bucket is
    `_row_seq // bucket_rows`; (2) for the first row of each bucket, the last
    value of the entity's previous non-empty bucket, from a lag over the first
    rows (one per bucket, each carrying its bucket's last value).
    per="snapshot" first keeps the primary row per snapshot (at most one row
    per snapshot per entity) and lags over those.
    """
    value = value or cols.org
    out_col = f"prev_{value}"
    if per == "snapshot":
        src = primary_rows(df, cols)
        out = src.withColumn(out_col, F.lag(value).over(Window.partitionBy(cols.id).orderBy(cols.date, cols.seq)))
    else:
        x = df.withColumn("_sb", F.floor(F.col(cols.seq) / F.lit(bucket_rows)))
        w_in = Window.partitionBy(cols.id, cols.date, "_sb").orderBy(cols.seq)
        whole = w_in.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = (x.withColumn("_lag_in", F.lag(value).over(w_in)).withColumn("_first", F.row_number().over(w_in) == 1)
              .withColumn("_last", F.last(value).over(whole)))
        # the first rows of an entity's buckets are one window, other rows stay with their bucket: every
        # window is by the entity first, so rows laid out by entity are not exchanged
        others = [F.when(~F.col("_first"), F.col(c)) for c in (cols.date, "_sb")]
        w_out = Window.partitionBy(cols.id, "_first", *others).orderBy(F.col(cols.date).asc_nulls_last(), "_sb")
        out = (x.withColumn(out_col, F.when(F.col("_first"), F.lag("_last").over(w_out)).otherwise(F.col("_lag_in")))
                .drop("_sb", "_lag_in", "_first", "_last"))
        # no id, no history (a grouped shift gives nothing for a missing key)
        out = out.withColumn(out_col, F.when(F.col(cols.id).isNotNull(), F.col(out_col)))
    p, v = F.col(out_col), F.col(value)
    # changed when previous exists and differs; a null current after a known
    # previous also counts (ledger L12)
    return out.withColumn("dept_changed", p.isNotNull() & ~v.eqNullSafe(p))


def baseline_changes(agg_df: DataFrame, keys: list[str], date: str, value: str,
                     start_date=None) -> DataFrame:
    """First non-null value per key in date order, change and % change.

    `agg_df` is already aggregated (keys x dates), so the window is small.
    With `start_date` the baseline is the value at that date (ignored by the
    reference; honoured here when given).
    """
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding,
                                                            Window.unboundedFollowing)
    if start_date is None:
        base = F.first(value, ignorenulls=True).over(w)
    else:
        base = F.max(F.when(F.col(date) == F.lit(start_date), F.col(value))).over(w)
    out = agg_df.withColumn("start_fte", base)
    out = out.withColumn("fte_change", F.col(value) - F.col("start_fte"))
    return out.withColumn("fte_pct_change", safe_div("fte_change", "start_fte") * F.lit(100.0))


def consecutive_pairs(df: DataFrame, cols: PanelCols = CLEAN, values: list[str] | None = None) -> DataFrame:
    """Primary row per entity at each pair of adjacent *global* snapshots.

    An entity missing from one snapshot gets no pair across the gap.  Uses
    the calendar ordinal and a lag over the entity's primary rows (at most
    one per snapshot), then keeps pairs whose ordinals differ by exactly 1.
    """
    values = values or [cols.measure, cols.weight, cols.division, cols.title, cols.category]
    cal = calendar(df, cols)
    prim = primary_rows(df, cols).join(F.broadcast(cal), cols.date)
    w = Window.partitionBy(cols.id).orderBy("snap_idx")
    out = prim
    for v in [cols.date, "snap_idx"] + values:
        out = out.withColumn(f"{v}_before", F.lag(v).over(w))
    out = out.where(F.col("snap_idx") - F.col("snap_idx_before") == 1)
    sel = [F.col(cols.id), F.col(f"{cols.date}_before"), F.col(cols.date).alias(f"{cols.date}_after")]
    for v in values:
        sel += [F.col(f"{v}_before"), F.col(v).alias(f"{v}_after")]
    return out.select(*sel)


# Labels of what changed.
TITLE_CHANGED, DIVISION_CHANGED, CATEGORY_CHANGED = "Title change", "Division transfer", "Category change"
PURE_INCREASE = "Same title/division — pure salary increase"


def change_reason(pairs: DataFrame, cols: PanelCols = CLEAN) -> Column:
    """B24: '; '-joined list of what changed, else the pure-increase label."""
    def differs(c):
        return ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    parts = F.concat_ws("; ",
                        F.when(differs(cols.title), F.lit(TITLE_CHANGED)),
                        F.when(differs(cols.division), F.lit(DIVISION_CHANGED)),
                        F.when(differs(cols.category), F.lit(CATEGORY_CHANGED)))
    return F.when(parts == "", F.lit(PURE_INCREASE)).otherwise(parts)


def first_last_snapshot(df: DataFrame, cols: PanelCols = CLEAN, values: list[str] | None = None,
                        start=None, end=None) -> DataFrame:
    """Primary row of each entity at the first and at the last snapshot
    (inner: entities present in both), as one grouped aggregation."""
    values = values or [cols.measure, cols.category, cols.real_weighted]
    if start is None or end is None:
        b = df.agg(F.struct(F.min(cols.date).alias("d0"), F.max(cols.date).alias("d1"))).scalar()
        d0 = b["d0"] if start is None else F.lit(start)
        d1 = b["d1"] if end is None else F.lit(end)
    else:
        d0, d1 = F.lit(start), F.lit(end)
    ends = df.where((F.col(cols.date) == d0) | (F.col(cols.date) == d1)) \
             .withColumn("_is_end", F.col(cols.date) == d1)
    prim = primary_rows(ends, cols)
    row = F.struct(*[F.col(v) for v in values])
    g = prim.groupBy(cols.id).agg(F.max_by(row, F.when(~F.col("_is_end"), F.lit(1))).alias("_s"),
                                  F.max_by(row, F.when(F.col("_is_end"), F.lit(1))).alias("_e"))
    g = g.where(F.col("_s").isNotNull() & F.col("_e").isNotNull())
    sel = [F.col(cols.id)]
    for v in values:
        sel += [F.col(f"_s.{v}").alias(f"{v}_start"), F.col(f"_e.{v}").alias(f"{v}_end")]
    return g.select(*sel)


def period_growth(series: DataFrame, date: str, keys: list[str], fte: str, value: str,
                  cal: DataFrame) -> DataFrame:
    """Change between adjacent snapshots of an aggregated series.

    months = max(days / 30.44, 1); annualised % = ((v1/v0)^(12/months) - 1) * 100,
    null when v0 is not positive.  `series` has one row per (keys, date).
    """
    s = series.join(F.broadcast(cal), date)
    prev = s.select(*keys, F.col("snap_idx").alias("_pidx"), F.col(date).alias("date_start"),
                    F.col(fte).alias("fte_start"), F.col(value).alias("salary_start"))
    cur = s.withColumn("_pidx", F.col("snap_idx") - 1)
    j = cur.join(prev, keys + ["_pidx"])
    months = F.greatest(F.datediff(F.col("date_end"), F.col("date_start")) / F.lit(30.44), F.lit(1.0))
    ratio = safe_div("salary_end", "salary_start")
    return (j.select(*keys, "date_start", F.col(date).alias("date_end"), "fte_start",
                     F.col(fte).alias("fte_end"), "salary_start", F.col(value).alias("salary_end"))
             .withColumn("months", months)
             .withColumn("fte_change", F.col("fte_end") - F.col("fte_start"))
             .withColumn("salary_change", F.col("salary_end") - F.col("salary_start"))
             .withColumn("salary_pct_change", pct_change("salary_end", "salary_start"))
             .withColumn("annualized_pct_change",
                         F.when(F.col("salary_start") > 0,
                                (F.pow(ratio, F.lit(12.0) / F.col("months")) - F.lit(1.0)) * F.lit(100.0))))
