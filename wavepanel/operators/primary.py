"""Row selection per group: exact dedup, primary appointment, entity index,
first/last record (E5, E7-E10).

All of them pick one row per group.  They are written as a grouped
``max_by(struct(row), struct(order))`` rather than ``row_number()`` over a
window: the aggregate is computed map-side first (partial aggregation), so a
group that holds a third of all rows is reduced on every executor before the
shuffle instead of landing whole in one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols


def _rank_key(c: Column, ascending: bool) -> Column:
    """Map an order key so that *larger is preferred* inside max_by."""
    return -c if ascending else c


def pick_one(df: DataFrame, keys: list[str], order: list[tuple[Column, bool]],
             drop_null_keys: bool = False) -> DataFrame:
    """One row per `keys`: the first row under `order` (list of (expr, asc)).

    Order expressions must be numeric (use `F.unix_date` for dates). Nulls in
    an order key sort last in both directions (pandas behaviour), because a
    null struct field compares lower than any value in max_by.
    """
    if drop_null_keys:
        df = df.na.drop(subset=keys)
    rest = [c for c in df.columns if c not in keys]
    ord_struct = F.struct(*[_rank_key(e, asc).alias(f"k{i}") for i, (e, asc) in enumerate(order)])
    picked = (df.groupBy(*keys)
                .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), ord_struct).alias("_best")))
    # the keys themselves, not copies of them: a layout by key still holds for the result
    return picked.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_best.`{c}`") for c in df.columns])


def exact_dedup(df: DataFrame, subset: list[str], seq: str = CLEAN.seq) -> DataFrame:
    """Keep the first row (lowest `seq`) of every set of rows equal on `subset`.

    Nulls compare equal, as in pandas `drop_duplicates`.
    """
    return pick_one(df, subset, [(F.col(seq), True)])


def primary_rows(df: DataFrame, cols: PanelCols = CLEAN, prefer: str = "highest") -> DataFrame:
    """The highest-measure row per (id, date); ties keep the first row."""
    return pick_one(df, [cols.id, cols.date],
                    [(F.col(cols.measure), prefer != "highest"), (F.col(cols.seq), True)])


def entity_index(df: DataFrame, cols: PanelCols = CLEAN, tie: str = "highest") -> DataFrame:
    """Latest record per entity plus `is_current` and `last_seen`.

    `tie="highest"` keeps the highest measure on the latest date (documented
    behaviour); `tie="lowest"` keeps the lowest (what the reference code does).
    """
    last = pick_one(df, [cols.id],
                    [(F.unix_date(F.col(cols.date)), False),
                     (F.col(cols.measure), tie != "highest"),
                     (F.col(cols.seq), True)])
    latest = df.agg(F.max(cols.date)).scalar()         # scalar subquery
    return (last.withColumn("is_current", F.col(cols.date) == latest)
                .withColumn("last_seen", F.col(cols.date)))


def first_last_records(df: DataFrame, cols: PanelCols = CLEAN,
                       values: list[str] | None = None) -> DataFrame:
    """First and last record per entity by (date, seq) in one pass."""
    values = values or [cols.date, cols.measure, cols.weight]
    ordk = F.struct(F.unix_date(F.col(cols.date)), F.col(cols.seq))
    row = F.struct(*[F.col(v) for v in values])
    agg = (df.groupBy(cols.id)
             .agg(F.min_by(row, ordk).alias("_first"), F.max_by(row, ordk).alias("_last")))
    out = [F.col(cols.id)]
    for v in values:
        out.append(F.col(f"_first.{v}").alias(f"{v}_first"))
        out.append(F.col(f"_last.{v}").alias(f"{v}_last"))
    return agg.select(*out)
