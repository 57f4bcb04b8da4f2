"""Price-index attach and real measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols


def base_index(cpi: DataFrame, base_date, date_col: str = "Date", cpi_col: str = "CPI",
               out: str = "CPI_2021_Index") -> DataFrame:
    """index = CPI at `base_date` / CPI; null column when the base is missing.

    The price series has one row per month (bounded), so the one-row base value
    is broadcast.
    """
    base = cpi.agg(F.max(F.when(F.col(date_col) == F.lit(base_date), F.col(cpi_col)))).scalar()
    return cpi.withColumn(out, F.try_divide(base, F.col(cpi_col)))


def deflate(panel: DataFrame, index: DataFrame, cols: PanelCols = CLEAN, idx_date: str = "Date",
            idx_val: str = "CPI_2021_Index", mode: str = "latest", carry: list[str] | None = None) -> DataFrame:
    """C1 + B8 + B10: attach the index and derive nominal and real measures.

    Adds ``cols.index``, ``cols.weighted`` (measure x weight),
    ``cols.real_weighted``, ``cols.real_measure`` and the index columns named in
    `carry`.  The panel is read once.  mode="latest" joins the index (one row
    per month, broadcast) on the date and fills every miss with the latest
    non-null row (the reference's rule); mode="asof" takes the nearest earlier
    non-null row, looked up in the sorted months (one small array value).
    """
    values = [idx_val, *[c for c in carry or [] if c != idx_val]]
    known = index.where(F.col(idx_val).isNotNull()).select(F.col(idx_date).alias("d"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    row = F.struct("d", *[f"v{i}" for i in range(len(values))])
    if mode == "latest":
        last = known.agg(F.max_by(row, "d")).scalar()
        months = F.broadcast(index.select(F.col(idx_date).alias("_d"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]))
        out = panel.join(months, F.col(cols.date) == F.col("_d"), "left").drop("_d")
        found = [F.coalesce(F.col(f"_v{i}"), last[f"v{i}"]) for i in range(len(values))]
    elif mode == "asof":
        months = known.agg(F.sort_array(F.collect_list(row))).scalar()
        out = panel.withColumn("_months", months)
        out = out.withColumn("_m", F.try_element_at(F.filter("_months", lambda r: r["d"] <= F.col(cols.date)), F.lit(-1)))
        found = [F.col("_m")[f"v{i}"] for i in range(len(values))]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    m, w = F.col(cols.measure), F.col(cols.weight)
    out = out.withColumns({cols.index: found[0], **{c: found[values.index(c)] for c in carry or []}})
    out = out.drop("_m", "_months", *[f"_v{i}" for i in range(len(values))])
    return (out.withColumn(cols.weighted, m * w)
               .withColumn(cols.real_weighted, m * w * F.col(cols.index))
               .withColumn(cols.real_measure, m * F.col(cols.index)))
