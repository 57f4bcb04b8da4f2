"""Grouped metrics over a panel.

Everything is a `groupBy().agg()` (partial aggregation map-side, then one
shuffle on the group keys) or a window over an *already aggregated* result,
whose size is bounded by (#groups x #snapshots), never by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..functions.numeric import pct_change, round_half_up, safe_div
from ..session import materialize
from . import prefix


def _drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    # pandas groupby drops null keys (ledger L1)
    return df.na.drop(subset=keys) if keys else df


def trend(df: DataFrame, cols: PanelCols = CLEAN, by: list[str] | None = None) -> DataFrame:
    """Per snapshot (and `by` keys): headcount, FTE, nominal and real pay."""
    keys = [cols.date] + list(by or [])
    g = _drop_null_keys(df, keys).groupBy(*keys).agg(
        F.count_distinct(cols.id).alias("employees"),
        F.sum(cols.weight).alias("total_fte"),
        F.sum(cols.weighted).alias("total_salary_nominal"),
        F.sum(cols.real_weighted).alias("total_salary_real"),
    )
    return g.withColumn("salary_per_fte_real", safe_div("total_salary_real", "total_fte"))


def latest_date(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """One-row scalar: the latest snapshot date."""
    return df.agg(F.max(cols.date).alias("_latest"))


def at_latest(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """Rows of the latest snapshot (C19: the date is a scalar subquery,
    computed once and compared like a literal)."""
    return df.where(F.col(cols.date) == latest_date(df, cols).scalar())


def headline(df: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """Distinct entities, FTE, real pay and distinct units of the latest snapshot."""
    return at_latest(df, cols).agg(
        F.max(cols.date).alias("snapshot"),
        F.count_distinct(cols.id).alias("employees"),
        F.sum(cols.weight).alias("total_fte"),
        F.sum(cols.real_weighted).alias("total_salary_real"),
        F.count_distinct(cols.department).alias("departments"),
    )


def overview(df: DataFrame, cols: PanelCols = CLEAN, approx: bool = False) -> DataFrame:
    """Date range and distinct counts (approximate HLL option at scale).

    Rows are first reduced to distinct (entity, division, department, code)
    with their counts, so the distinct counts expand those, not raw rows."""
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    each = df.groupBy(cols.id, cols.division, cols.department, cols.jobcode).agg(
        F.min(cols.date).alias("_d0"), F.max(cols.date).alias("_d1"), F.count(F.lit(1)).alias("_n"))
    return each.agg(
        F.min("_d0").alias("first_date"), F.max("_d1").alias("last_date"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records"),
        cd(cols.id).alias("entities"), cd(cols.division).alias("divisions"),
        cd(cols.department).alias("departments"), cd(cols.jobcode).alias("jobcodes"),
    )


def snapshot_bounds(df: DataFrame, cols: PanelCols = CLEAN):
    """(first, last) snapshot date as scalar-subquery columns (one subquery,
    reused for both ends)."""
    b = df.agg(F.struct(F.min(cols.date).alias("d0"), F.max(cols.date).alias("d1"))).scalar()
    return b["d0"], b["d1"]


def compare_snapshots(df: DataFrame, keys: list[str], cols: PanelCols = CLEAN,
                      start=None, end=None, value_cols: dict[str, str] | None = None,
                      drop_empty: bool = True) -> DataFrame:
    """before/after by any keys in one pass (conditional aggregation).

    `start`/`end` default to the panel's first and last snapshot.  For each
    value column: `<name>_start`, `<name>_end`, `<name>_change`,
    `<name>_pct_change` (null when the start is 0).  Keys with no weight at
    either date are dropped, like the reference's tables.
    """
    value_cols = value_cols or {"fte": cols.weight, "salary": cols.real_weighted}
    if start is None or end is None:
        b0, b1 = snapshot_bounds(df, cols)
        d0 = b0 if start is None else F.lit(start)
        d1 = b1 if end is None else F.lit(end)
    else:
        d0, d1 = F.lit(start), F.lit(end)
    df = _drop_null_keys(df, keys)
    df = df.where((F.col(cols.date) == d0) | (F.col(cols.date) == d1))
    aggs = []
    for name, c in value_cols.items():
        aggs.append(F.coalesce(F.sum(F.when(F.col(cols.date) == d0, F.col(c))), F.lit(0.0)).alias(f"{name}_start"))
        aggs.append(F.coalesce(F.sum(F.when(F.col(cols.date) == d1, F.col(c))), F.lit(0.0)).alias(f"{name}_end"))
    g = df.groupBy(*keys).agg(*aggs)
    for name in value_cols:
        g = (g.withColumn(f"{name}_change", F.col(f"{name}_end") - F.col(f"{name}_start"))
              .withColumn(f"{name}_pct_change", pct_change(f"{name}_end", f"{name}_start")))
    if drop_empty:
        first = next(iter(value_cols))
        g = g.where((F.col(f"{first}_start") != 0) | (F.col(f"{first}_end") != 0))
    return g


def with_total_row(cmp: DataFrame, key: str, value_names: list[str],
                   label: str = "TOTAL", parts: list[str] | None = None) -> DataFrame:
    """Append a TOTAL row whose percentages are recomputed from the sums.
    With `parts` only the rows of these keys are shown and summed (the named
    types; a residual type such as "Other" is neither).

    The input is an aggregated comparison (one row per key), so the extra
    global aggregate runs over (#keys) rows only.
    """
    aggs = []
    for n in value_names:
        aggs += [F.sum(f"{n}_start").alias(f"{n}_start"), F.sum(f"{n}_end").alias(f"{n}_end")]
    if parts is not None:
        cmp = cmp.where(F.col(key).isin(parts))
    tot = cmp.agg(*aggs).withColumn(key, F.lit(label))
    for n in value_names:
        tot = (tot.withColumn(f"{n}_change", F.col(f"{n}_end") - F.col(f"{n}_start"))
                  .withColumn(f"{n}_pct_change", pct_change(f"{n}_end", f"{n}_start")))
    return cmp.unionByName(tot.select(*cmp.columns))


def top_k(df: DataFrame, value: str, ties: list[str], k: int, largest: bool = True) -> DataFrame:
    """the `k` rows with the largest (or smallest) value, ties by `ties`; a
    missing value is neither."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    return df.where(F.col(value).isNotNull()).orderBy(order, *ties).limit(k)


def head_and_tail(df: DataFrame, value: str, ties: list[str], k: int) -> DataFrame:
    """the first and the last `k` rows of one ordering, marked by `side`."""
    up = top_k(df, value, ties, k).withColumn("side", F.lit("increase"))
    return up.unionByName(top_k(df, value, ties, k, largest=False).withColumn("side", F.lit("decrease")))


def cross_tab(df: DataFrame, key: str, by: str, by_values: list, k: int, cols: PanelCols = CLEAN) -> DataFrame:
    """before/after of the `k` keys with the most weight at the last snapshot
    (ties by key) for each given value of `by`; cells without rows are zeros.
    The grid has k x len(by_values) rows."""
    last = at_latest(df, cols).na.drop(subset=[key])
    # sums compared at 4 digits: a floating-point sum depends on its order
    top = top_k(last.groupBy(key).agg(round_half_up(F.sum(cols.weight), 4).alias("_w")), "_w", [key], k).select(key)
    grid = top.withColumn(by, F.explode(F.array(*[F.lit(v) for v in by_values])))
    cmp = compare_snapshots(df.where(F.col(by).isin(by_values)), [key, by], cols)
    numbers = [c for c in cmp.columns if c not in (key, by) and not c.endswith("_pct_change")]
    return F.broadcast(grid).join(cmp, [key, by], "left").na.fill(0.0, numbers)


def group_proportion(df: DataFrame, cols: PanelCols = CLEAN, group: list[str] | None = None,
                     part: str | None = None) -> DataFrame:
    """FTE share of each `part` inside (group keys, date).

    The denominator is a window over the aggregated rows (C4: no join back).
    """
    group = group or [cols.division, cols.department]
    part = part or cols.jobgroup
    keys = group + [cols.date]
    g = (_drop_null_keys(df, keys + [part]).groupBy(*keys, part)
           .agg(F.sum(cols.weight).alias(cols.weight)))
    w = Window.partitionBy(*keys)
    return (g.withColumn("total_fte", F.sum(cols.weight).over(w))
             .withColumn("fte_proportion", safe_div(cols.weight, "total_fte")))


def share_of_total(df: DataFrame, cols: PanelCols = CLEAN, part: str | None = None,
                   value: str | None = None, parts: list[str] | None = None) -> DataFrame:
    """Each part's share of the per-date total (optionally only named parts)."""
    part = part or cols.div_type
    value = value or cols.real_weighted
    src = df if parts is None else df.where(F.col(part).isin(parts))
    g = (_drop_null_keys(src, [cols.date, part]).groupBy(cols.date, part)
           .agg(F.sum(value).alias("value"), F.sum(cols.weight).alias("fte")))
    w = Window.partitionBy(cols.date)
    return (g.withColumn("value_share", safe_div("value", F.sum("value").over(w)) * 100.0)
             .withColumn("fte_share", safe_div("fte", F.sum("fte").over(w)) * 100.0))


def pivot_by_date(df: DataFrame, rows: list[str], cols: PanelCols = CLEAN,
                  value: str | None = None, dates: list | None = None, agg: str = "sum") -> DataFrame:
    """`rows` x snapshot-date wide table.

    Pass `dates` (the calendar) to avoid the extra distinct job Spark runs to
    discover pivot values; the column count equals the number of snapshots.
    """
    value = value or cols.weight
    fn = {"sum": F.sum, "avg": F.avg, "count": F.count}[agg]
    g = _drop_null_keys(df, rows + [cols.date]).groupBy(*rows)
    g = g.pivot(cols.date, dates) if dates is not None else g.pivot(cols.date)
    return g.agg(fn(value))


def unpivot(df: DataFrame, ids: list[str], values: list[str], var: str = "variable",
            val: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(ids, values, var, val)


def _qname(q: float) -> str:
    """p05, p50, p100; p99_5 for a fraction of a percent."""
    text = f"{round(q * 100, 6):g}"
    return "p" + (text.zfill(2) if "." not in text else text.replace(".", "_"))


# Distinct values of one group that a window may hold; larger groups are ranked over range partitions.
RANK_BUDGET = 1 << 20


def ranked_values(df: DataFrame, keys: list[str], value: str, budget: int = RANK_BUDGET) -> DataFrame:
    """(keys, value, _c, _before, _n, _rows): the distinct values of each group with
    their multiplicities, the number of the group's values strictly below, the
    number of its values and of its rows.  Nulls and NaNs are rows but no values:
    they stand last and count in _rows alone.

    Rows are reduced to distinct values first (partial aggregation) and stored, so
    that what leads up to them runs once.  If no group
    has more than `budget` of them -- one number is asked -- a running count per
    group ranks them.  Otherwise all groups are ranked at once by a distributed
    running total in (keys, value) order: range partitions split a group of any
    size, and a group's first total is taken off.
    """
    v = F.col(value)
    vals = materialize(df.groupBy(*keys, F.when(~F.isnan(v.cast("double")), v).alias(value)).agg(F.count(F.lit(1)).alias("_c")), "values")
    real = F.when(v.isNotNull(), F.col("_c")).otherwise(F.lit(0))
    most = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d").alias("d")).first()["d"] or 0
    if most <= budget:
        group = Window.partitionBy(*keys)
        upto = group.orderBy(v.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        return vals.select(*keys, value, "_c", F.coalesce(F.sum(real).over(upto), F.lit(0)).alias("_before"),
                           F.sum(real).over(group).alias("_n"), F.sum("_c").over(group).alias("_rows"))
    run = prefix.running_total(vals, [*[F.col(c) for c in keys], v.asc_nulls_last()], real, "_upto")
    run = run.withColumn("_upto", F.col("_upto") - real)
    sizes = run.groupBy(*keys).agg(F.min("_upto").alias("_start"), F.sum(real).alias("_n"), F.sum("_c").alias("_rows"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in keys]
    return (run.alias("r").join(sizes.alias("g"), same)
            .select(*[F.col(f"r.{c}") for c in keys], F.col(f"r.{value}"), "_c", (F.col("_upto") - F.col("_start")).alias("_before"), "_n", "_rows"))


def exact_quantiles_of(df: DataFrame, keys: list[str], values: dict[str, dict[float, str] | str]) -> DataFrame:
    """Exact quantiles of several measures in a single pass: `values` maps a
    measure to the names of its quantiles (or just its median's).  The measures
    become a key column."""
    names = {v: {0.5: n} if isinstance(n, str) else n for v, n in values.items()}
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("v")) for v in values]))
                     .alias("_x")).select(*keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
    found = exact_quantiles(long, [*keys, "_m"], "_v", tuple(sorted({q for n in names.values() for q in n})))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == v, F.col(_qname(q)))).alias(name)
                                      for v, n in names.items() for q, name in n.items()])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles=(0.5,), budget: int = RANK_BUDGET) -> DataFrame:
    """Exact quantiles per group (linear interpolation between the order
    statistics at (n-1)q, as numpy and SQL `percentile`) without holding a
    group's values in one task: `ranked_values` gives every distinct value its
    range of positions, and a grouped aggregate picks the ones asked for.
    Groups without a value give no row."""
    ranked = ranked_values(df, list(keys), value, budget).where(F.col(value).isNotNull())
    return pick_quantiles(ranked, list(keys), value, quantiles)


def pick_quantiles(ranked: DataFrame, keys: list[str], value: str, quantiles, extra: list[Column] | None = None) -> DataFrame:
    """The quantiles' columns from `ranked_values` rows (and further aggregates of the same groups)."""
    aggs, outs = list(extra or []), []
    for q in quantiles:
        n, pos = _qname(q), (F.col("_n") - 1) * F.lit(float(q))
        covers = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_c"))
        aggs += [F.max(F.when(covers(F.floor(pos)), F.col(value))).alias(f"_lo{n}"),
                 F.max(F.when(covers(F.ceil(pos)), F.col(value))).alias(f"_hi{n}"),
                 F.max(pos - F.floor(pos)).alias(f"_fr{n}")]
        lo, hi, part = F.col(f"_lo{n}"), F.col(f"_hi{n}"), F.col(f"_fr{n}")
        outs.append(F.when(part == 0, lo).otherwise(lo + (hi - lo) * part).alias(n))
    found = ranked.groupBy(*keys).agg(*aggs)
    own = [c for c in found.columns if not c.startswith(("_lo", "_hi", "_fr"))]
    return found.select(*own, *outs)


def group_stats(df: DataFrame, keys: list[str], value: str, quantiles=(0.1, 0.25, 0.5, 0.75, 0.9),
                method: str = "distributed") -> DataFrame:
    """Count, mean, min, max and quantiles per group.

    method="distributed" (default): exact quantiles by `exact_quantiles`, safe
    for a group holding a large share of all rows; "builtin": Spark's exact
    `percentile` (keeps each group's distinct values in one task's memory);
    "approx": `percentile_approx` with a bounded sketch.
    """
    df = _drop_null_keys(df, keys)
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"),
            F.min(value).alias("min"), F.max(value).alias("max")]
    if method == "distributed":
        k = keys or ["_all"]
        src = df if keys else df.withColumn("_all", F.lit(0))
        base = src.groupBy(*k).agg(*aggs)
        out = base.join(exact_quantiles(src, k, value, quantiles), k, "left")   # one row per group each side
        return out if keys else out.drop("_all")
    for q in quantiles:
        if method == "approx":
            aggs.append(F.percentile_approx(value, q, 10000).alias(_qname(q)))
        else:
            aggs.append(F.percentile(value, F.lit(q)).alias(_qname(q)))
    return df.groupBy(*keys).agg(*aggs)


def histogram(df: DataFrame, value: str, bins: int = 20, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the min and the max (per group when keyed).

    Bin edges come from a grouped min/max (bounded by #groups), joined back;
    the counting itself is one more grouped aggregate.
    """
    keys = keys or []
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if keys:
        # one row per group; AQE broadcasts it at run time when it is small
        rng = base.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        j = base.join(rng, keys)
    else:
        r = base.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        j = base.withColumn("_lo", r["lo"]).withColumn("_hi", r["hi"])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width).cast("int"), F.lit(bins - 1)))
    return (j.withColumn("bin", b)
             .groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
             .withColumn("bin_low", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.lit(bins))
             .withColumn("bin_high", F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / F.lit(bins))
             .drop("_lo", "_hi"))


def linear_trend(df: DataFrame, y: str, x: str, keys: list[str] | None = None,
                 method: str = "two_pass") -> DataFrame:
    """Least-squares slope/intercept of y on x, when >= 3 points and x varies.

    method="two_pass" (default): group means first, then centred sums
    slope = S(dx*dy) / S(dx^2), intercept = my - slope*mx -- two grouped
    aggregates and a join on the group keys (no window), numerically stabler
    than one-pass moments and reproducible by any SQL engine;
    method="builtin": Spark's `regr_slope` / `regr_intercept`.
    """
    keys = keys or []
    k = keys or ["_all"]
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not keys:
        src = src.withColumn("_all", F.lit(0))
    # "x varies" is tested exactly (min < max): a variance computed from
    # rounded means can be a tiny non-zero number for constant x
    if method == "builtin":
        ok = (F.count(F.lit(1)) > 2) & (F.min(x) < F.max(x))
        out = src.groupBy(*k).agg(F.count(F.lit(1)).alias("n"),
                                  F.when(ok, F.regr_slope(y, x)).alias("slope"),
                                  F.when(ok, F.regr_intercept(y, x)).alias("intercept"))
        return out if keys else out.drop("_all")
    means = src.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
                                (F.min(x) < F.max(x)).alias("_varies"))
    c = src.join(means, k)
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = c.groupBy(*k, "n", "_mx", "_my", "_varies").agg(F.sum(dx * dy).alias("_sxy"),
                                                           F.sum(dx * dx).alias("_sxx"))
    ok = (F.col("n") > 2) & F.col("_varies") & (F.col("_sxx") > 0)
    slope = F.when(ok, F.col("_sxy") / F.col("_sxx"))
    out = sums.select(*k, "n", slope.alias("slope"),
                      F.when(ok, F.col("_my") - F.col("_sxy") / F.col("_sxx") * F.col("_mx")).alias("intercept"))
    return out if keys else out.drop("_all")


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Number of non-empty values per field, as a long table."""
    wide = df.agg(*[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f)
                    for f in fields])
    return wide.unpivot([], fields, "field", "non_empty")


def first_last_change(df: DataFrame, keys: list[str], value: str, date: str) -> DataFrame:
    """First and last value of an (aggregated) series per key, and the change."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    out = g.agg(F.min_by(value, date).alias("first_value"), F.max_by(value, date).alias("last_value"))
    return (out.withColumn("change", F.col("last_value") - F.col("first_value"))
               .withColumn("pct_change", F.when(F.col("first_value") > 0,
                                                pct_change("last_value", "first_value"))))


def rollup_totals(df: DataFrame, keys: list[str], aggs: list[Column], label: str = "TOTAL") -> DataFrame:
    """Group rows plus subtotal/total rows via `rollup`."""
    g = _drop_null_keys(df, keys).rollup(*keys).agg(*aggs, *[F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        g = g.withColumn(k, F.when(F.col(f"_g{i}") == 1, F.lit(label)).otherwise(F.col(k).cast("string")))
    return g.drop(*[f"_g{i}" for i in range(len(keys))])
