"""Consolidation (cohort) study and function-level before/after (K21, K22,
C14-C17, D15, D17, D30, D37, G4, G6).

Everything is keyed joins and grouped aggregations over two snapshots; the
start-to-end price factor is a one-row scalar (C19) broadcast to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..functions.numeric import pct_change
from ..functions.text import keyword_category
from .aggregate import exact_quantiles_of
from .primary import pick_one

ORIGINAL = "Administration (original)"
MOVED = "Moved (from departments)"
NEW = "New (not in analysis)"


def _primary_by_key(df: DataFrame, key: str, cols: PanelCols) -> DataFrame:
    return pick_one(df, [key], [(F.col(cols.measure), False), (F.col(cols.seq), True)])


def cohort_moves(df: DataFrame, start, end, admin_units: list[str], keywords,
                 cols: PanelCols = CLEAN, key: str | None = None, unit: str | None = None) -> dict[str, DataFrame]:
    """People in the admin units at `end` who also existed at `start`.

    Returns {"merged": the two-snapshot comparison, "end_admin": everyone in
    the admin units at the end}.  Primary row per person = highest measure;
    zero-measure and zero-weight rows are ignored.
    """
    key = key or cols.id
    unit = unit or cols.department
    pos = df.where((F.col(cols.measure) > 0) & (F.col(cols.weight) > 0))
    s = _primary_by_key(pos.where(F.col(cols.date) == F.lit(start)), key, cols)
    e = _primary_by_key(pos.where((F.col(cols.date) == F.lit(end)) & F.col(unit).isin(admin_units)), key, cols)
    keep = [unit, cols.title, cols.measure, cols.weight]
    s_ = s.select(key, *[F.col(c).alias(f"{c}_start") for c in keep])
    e_ = e.select(key, *[F.col(c).alias(f"{c}_end") for c in keep])
    m = e_.join(s_, key)
    in_admin = F.coalesce(F.col(f"{unit}_start").isin(admin_units), F.lit(False))
    m = (m.withColumn("group", F.when(in_admin, F.lit(ORIGINAL)).otherwise(F.lit(MOVED)))
          .withColumn("salary_start", F.col(f"{cols.measure}_start"))
          .withColumn("salary_end", F.col(f"{cols.measure}_end"))
          .withColumn("salary_change", F.col("salary_end") - F.col("salary_start"))
          .withColumn("pct_change", F.col("salary_change") / F.col("salary_start") * F.lit(100.0))
          .withColumn("category", keyword_category(f"{cols.title}_end", keywords))
          .withColumn("source_dept", F.when(~in_admin, F.col(f"{unit}_start"))
                      .otherwise(F.lit("Administration"))))
    return {"merged": m, "end_admin": e}


def group_summary(merged: DataFrame, keys: list[str], quartiles: bool = True) -> DataFrame:
    """N, medians of start/end measure, median/mean % change (+ quartiles).

    Exact quantiles of all three measures in one pass (a group may hold most rows)."""
    base = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("pct_change").alias("mean_pct"))
    pct = {0.25: "pct_25", 0.5: "median_pct", 0.75: "pct_75"} if quartiles else {0.5: "median_pct"}
    found = exact_quantiles_of(merged, keys, {"pct_change": pct, "salary_start": "median_start", "salary_end": "median_end"})
    return base.join(found, keys, "left")


def first_move_dates(df: DataFrame, merged: DataFrame, admin_units: list[str], cols: PanelCols = CLEAN,
                     key: str | None = None, unit: str | None = None, since=None) -> DataFrame:
    """First snapshot (>= `since`) at which each moved person appears
    in an admin unit; the original group gets the label 'Already in Admin'."""
    key = key or cols.id
    unit = unit or cols.department
    moved = merged.where(F.col("group") == MOVED).select(key)
    rows = df.where(F.col(unit).isin(admin_units))
    if since is not None:
        rows = rows.where(F.col(cols.date) >= F.lit(since))
    first = (rows.join(moved, key, "left_semi").groupBy(key)
                 .agg(F.date_format(F.min(cols.date), "yyyy-MM").alias("_md")))
    out = merged.join(first, key, "left")
    return out.withColumn("move_date", F.when(F.col("group") == ORIGINAL, F.lit("Already in Admin"))
                          .otherwise(F.col("_md"))).drop("_md")


def detail_with_new(merged: DataFrame, end_admin: DataFrame, keywords, cols: PanelCols = CLEAN,
                    key: str | None = None) -> DataFrame:
    """The comparison rows plus current admin people absent at the
    start (anti join), with the start-side columns null."""
    key = key or cols.id
    new = (end_admin.join(merged.select(key), key, "left_anti")
                    .select(key, F.lit(NEW).alias("group"),
                            keyword_category(cols.title, keywords).alias("category"),
                            F.col(cols.title).alias(f"{cols.title}_end"),
                            F.col(cols.weight).alias(f"{cols.weight}_end"),
                            F.col(cols.measure).alias("salary_end")))
    cols_out = [key, "group", "category", f"{cols.title}_start", f"{cols.title}_end", "source_dept",
                f"{cols.weight}_start", f"{cols.weight}_end", "salary_start", "salary_end",
                "salary_change", "pct_change"]
    return merged.select(*cols_out).unionByName(new, allowMissingColumns=True)


def price_factor(index: DataFrame, start, date_col: str, idx_col: str) -> DataFrame:
    """One-row factor that moves start-date money into latest-index money."""
    return index.agg(F.try_divide(
        F.max(F.when(F.col(date_col) == F.lit(start), F.col(idx_col))),
        F.max_by(F.when(F.col(idx_col).isNotNull(), F.col(idx_col)),
                 F.when(F.col(idx_col).isNotNull(), F.col(date_col)))).alias("_factor"))


def _function_rows(df: DataFrame, start, end, keywords, factor: DataFrame, cols: PanelCols,
                   admin_units: list[str] | None, unit: str | None) -> DataFrame:
    x = df.where((F.col(cols.weight) > 0) & F.col(cols.date).isin(F.lit(start), F.lit(end)))
    x = x.withColumn("_factor", factor.scalar())             # one-row scalar subquery
    is_start = F.col(cols.date) == F.lit(start)
    pay = F.col(cols.measure) * F.col(cols.weight) * F.when(is_start, F.col("_factor")).otherwise(F.lit(1.0))
    x = (x.withColumn("total_pay", pay)
          .withColumn("category", keyword_category(cols.title, keywords))
          .withColumn("_is_start", is_start)
          .where(F.col("category") != "Other"))
    if admin_units is not None:
        x = x.withColumn("location", F.when(F.coalesce(F.col(unit or cols.department).isin(admin_units),
                                                       F.lit(False)), F.lit("Administration"))
                         .otherwise(F.lit("Departments")))
    return x


def _cond_sum(cond: Column, c: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))


def function_compare(df: DataFrame, start, end, keywords, factor: DataFrame,
                     cols: PanelCols = CLEAN) -> DataFrame:
    """FTE and pay per job function at two dates (start money moved
    to end money), one conditional aggregation, plus a TOTAL row."""
    x = _function_rows(df, start, end, keywords, factor, cols, None, None)
    s, e = F.col("_is_start"), ~F.col("_is_start")
    g = x.groupBy("category").agg(_cond_sum(s, cols.weight).alias("fte_start"),
                                  _cond_sum(e, cols.weight).alias("fte_end"),
                                  _cond_sum(s, "total_pay").alias("pay_start"),
                                  _cond_sum(e, "total_pay").alias("pay_end"))
    tot = g.agg(*[F.sum(c).alias(c) for c in ("fte_start", "fte_end", "pay_start", "pay_end")]) \
           .withColumn("category", F.lit("TOTAL"))
    g = g.unionByName(tot)
    return (g.withColumn("fte_change", F.col("fte_end") - F.col("fte_start"))
             .withColumn("pay_change", F.col("pay_end") - F.col("pay_start"))
             .withColumn("fte_pct_change", pct_change("fte_end", "fte_start"))
             .withColumn("pay_pct_change", pct_change("pay_end", "pay_start")))


def function_by_title(df: DataFrame, start, end, keywords, factor: DataFrame,
                      cols: PanelCols = CLEAN) -> DataFrame:
    """(function, title) before/after with counts; missing side = 0."""
    x = _function_rows(df, start, end, keywords, factor, cols, None, None)
    s, e = F.col("_is_start"), ~F.col("_is_start")
    g = x.groupBy("category", cols.title).agg(
        _cond_sum(s, cols.weight).alias("fte_start"), F.count(F.when(s, F.lit(1))).alias("n_start"),
        _cond_sum(s, "total_pay").alias("pay_start"),
        _cond_sum(e, cols.weight).alias("fte_end"), F.count(F.when(e, F.lit(1))).alias("n_end"),
        _cond_sum(e, "total_pay").alias("pay_end"))
    return (g.withColumn("fte_change", F.col("fte_end") - F.col("fte_start"))
             .withColumn("pay_change", F.col("pay_end") - F.col("pay_start")))


def function_by_location(df: DataFrame, start, end, keywords, factor: DataFrame, admin_units: list[str],
                         cols: PanelCols = CLEAN, unit: str | None = None) -> DataFrame:
    """Function x location (Administration / Departments) wide
    table for both dates (absent cells 0), totals, net change, TOTAL row."""
    x = _function_rows(df, start, end, keywords, factor, cols, admin_units, unit)
    s, e = F.col("_is_start"), ~F.col("_is_start")
    adm = F.col("location") == "Administration"
    aggs = []
    for side, cond in (("start", s), ("end", e)):
        for loc, lc in (("admin", adm), ("depts", ~adm)):
            aggs.append(_cond_sum(cond & lc, cols.weight).alias(f"{side}_fte_{loc}"))
            aggs.append(_cond_sum(cond & lc, "total_pay").alias(f"{side}_pay_{loc}"))
    g = x.groupBy("category").agg(*aggs)
    value_cols = [c for c in g.columns if c != "category"]
    tot = g.agg(*[F.sum(c).alias(c) for c in value_cols]).withColumn("category", F.lit("TOTAL"))
    g = g.unionByName(tot)
    for side in ("start", "end"):
        for m in ("fte", "pay"):
            g = g.withColumn(f"{side}_{m}_total", F.col(f"{side}_{m}_admin") + F.col(f"{side}_{m}_depts"))
    return (g.withColumn("fte_net_change", F.col("end_fte_total") - F.col("start_fte_total"))
             .withColumn("pay_net_change", F.col("end_pay_total") - F.col("start_pay_total")))
