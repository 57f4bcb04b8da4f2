"""Budget-reduction scenarios.

All scenarios run on one snapshot of a unit hierarchy.  Scalars (college
totals, uniform rates) are one-row aggregates broadcast to the unit rows;
per-unit figures are grouped conditional aggregations.  The ordered walks over raw
rows -- "cut the highest salaries until the target is met" (E16), plan numbers
(E18) -- are distributed prefix sums (`prefix`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..functions.numeric import safe_div
from ..functions.text import keyword_category
from . import prefix


@dataclass(frozen=True)
class Scenario:
    """Parameters of a reduction scenario (all of them are data, not code)."""
    target_cost: float = 13_000_000.0          # cut in total cost (salary + overhead)
    overhead: float = 0.30                     # overhead on listed salaries
    protected_value: str = "Faculty"           # category that cannot be cut
    management_keywords: tuple = ()            # title keywords that mark management
    unit: str | None = None                    # unit column (default: department)

    @property
    def target_salary(self) -> float:
        return self.target_cost / (1.0 + self.overhead)


def classify(df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """`is_protected` by category and `is_management` by title keyword
    (management is never protected)."""
    prot = F.coalesce(F.col(cols.category) == F.lit(sc.protected_value), F.lit(False))
    mgmt = keyword_category(cols.title, [("M", list(sc.management_keywords))], "N") == "M" \
        if sc.management_keywords else F.lit(False)
    return df.withColumn("is_protected", prot).withColumn("is_management", ~prot & mgmt)


def _unit(sc: Scenario, cols: PanelCols) -> str:
    return sc.unit or cols.department


def uniform_cut(df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """Per unit, the uniform % of the college's total cost applied to the
    unit's listed salaries, effective % on the unprotected pool, and
    estimated positions (cut / mean unprotected salary)."""
    u = _unit(sc, cols)
    x = classify(df, sc, cols)
    m, up = F.col(cols.measure), ~F.col("is_protected")
    units = x.na.drop(subset=[u]).groupBy(u).agg(
        F.count(F.lit(1)).alias("employees"),
        F.count(F.when(F.col("is_protected"), F.lit(1))).alias("protected"),
        F.count(F.when(up, F.lit(1))).alias("unprotected"),
        F.coalesce(F.sum(m), F.lit(0.0)).alias("total_salary"),
        F.coalesce(F.sum(F.when(up, m)), F.lit(0.0)).alias("unprotected_salary"),
        F.avg(F.when(up, m)).alias("mean_unprotected_salary"))
    rate = x.agg(F.try_divide(F.lit(sc.target_salary), F.sum(m))).scalar()   # scalar subquery; null for a zero sum
    j = units.withColumn("uniform_rate", rate)
    cut = F.col("uniform_rate") * F.col("total_salary")
    return (j.withColumn("required_cut", cut)
             .withColumn("effective_pct", safe_div(cut, "unprotected_salary") * F.lit(100.0))
             .withColumn("est_positions", safe_div(cut, "mean_unprotected_salary"))
             .withColumn("uniform_pct", F.col("uniform_rate") * F.lit(100.0)))


def severity_tier(eff: Column) -> Column:
    """Tier label from the effective % cut."""
    return (F.when(eff > 15, F.lit("1 - Severe")).when(eff > 8, F.lit("2 - High"))
             .when(eff > 5, F.lit("3 - Moderate")).when(eff > 3, F.lit("4 - Standard"))
             .otherwise(F.lit("5 - Baseline")))


def severity_rollup(cut: DataFrame, df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """Tiers with unit count, positions at risk and dollars, plus a
    TOTAL row that carries both the summed positions and the global ratio
    (total cut / college-wide mean unprotected salary)."""
    t = cut.withColumn("tier", severity_tier(F.col("effective_pct")))
    g = t.rollup("tier").agg(F.count(F.lit(1)).alias("units"),
                             F.coalesce(F.sum("est_positions"), F.lit(0.0)).alias("positions"),
                             F.sum("required_cut").alias("dollars"))
    x = classify(df, sc, cols)
    mean_up = x.agg(F.avg(F.when(~F.col("is_protected"), F.col(cols.measure)))).scalar()
    g = g.withColumn("_mu", mean_up)
    return (g.withColumn("positions_global", F.when(F.col("tier").isNull(),
                                                    safe_div("dollars", "_mu")))
             .withColumn("tier", F.coalesce("tier", F.lit("Total"))).drop("_mu"))


def composition(df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """Headcount, FTE and salary by category, with the unprotected
    subtotal, the protected group and the grand total (rollup)."""
    x = classify(df, sc, cols).withColumn(
        "class", F.when(F.col("is_protected"), F.lit("Protected")).otherwise(F.lit("Unprotected")))
    # a null category is no group (ledger L1); the level comes from the grouping
    # itself, never from a null in the data
    g = x.na.drop(subset=[cols.category]).rollup("class", cols.category).agg(
        F.count(F.lit(1)).alias("headcount"), F.sum(cols.weight).alias("fte"), F.sum(cols.measure).alias("total_salary"),
        F.grouping("class").alias("_all"), F.grouping(cols.category).alias("_sub"))
    return (g.withColumn("level", F.when(F.col("_all") == 1, F.lit("grand_total"))
                         .when(F.col("_sub") == 1, F.lit("subtotal")).otherwise(F.lit("category")))
             .withColumn("class", F.when(F.col("_all") == 1, F.lit("All")).otherwise(F.col("class")))
             .withColumn(cols.category, F.when(F.col("_sub") == 1, F.lit("All")).otherwise(F.col(cols.category)))
             .drop("_all", "_sub"))


def take_until(df: DataFrame, value: str, target: float, seq: str) -> DataFrame:
    """Rows in descending `value` order (ties by `seq`) until the running
    total reaches `target`; the row that crosses is kept (see `prefix.until`)."""
    return prefix.until(df, value, [F.col(seq)], float(target))


def management_first(df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """Management rows cut from the highest salary down until the
    listed-salary target is met."""
    x = classify(df, sc, cols).where(F.col("is_management"))
    return take_until(x, cols.measure, sc.target_salary, cols.seq)


def management_protected(df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """Uniform rate over the non-management unprotected pool; per unit:
    pool size, pool salary, cut and estimated positions."""
    u = _unit(sc, cols)
    pool = classify(df, sc, cols).where(~F.col("is_protected") & ~F.col("is_management"))
    rate = pool.agg(F.try_divide(F.lit(sc.target_salary), F.sum(cols.measure))).scalar()
    g = pool.na.drop(subset=[u]).groupBy(u).agg(F.count(F.lit(1)).alias("pool_staff"),
                                                F.sum(cols.measure).alias("pool_salary"),
                                                F.avg(cols.measure).alias("_mean"))
    g = g.withColumn("pool_rate", rate)
    return (g.withColumn("cut_amount", F.col("pool_rate") * F.col("pool_salary"))
             .withColumn("est_positions", safe_div("cut_amount", "_mean"))
             .withColumn("pool_pct", F.col("pool_rate") * F.lit(100.0)).drop("_mean"))


def compare_scenarios(uniform: DataFrame, first: DataFrame, protected: DataFrame, unit: str) -> DataFrame:
    """The three scenarios side by side per unit (full outer, missing = 0).
    All three inputs have one row per unit."""
    a = first.groupBy(unit).agg(F.count(F.lit(1)).alias("mgmt_first_positions"))
    b = protected.select(unit, F.col("est_positions").alias("mgmt_protected_positions"))
    c = uniform.select(unit, F.col("est_positions").alias("uniform_positions"))
    j = c.join(a, unit, "full").join(b, unit, "full")
    return j.na.fill(0, ["mgmt_first_positions"]).na.fill(0.0, ["mgmt_protected_positions", "uniform_positions"])


# Salary band edges (lower bounds, descending) and labels.
SALARY_BANDS = [(200000, ">$200K"), (150000, "$150K-$200K"), (125000, "$125K-$150K"),
                (100000, "$100K-$125K"), (75000, "$75K-$100K"), (None, "<$75K")]


def salary_band(c: Column) -> Column:
    expr = None
    for lo, label in SALARY_BANDS:
        if lo is None:
            return expr.otherwise(F.lit(label))
        cond = c > F.lit(lo) if lo == 200000 else c >= F.lit(lo)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def salary_bands(df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """Management headcount and salary per band, plus the total (rollup).
    Rows without a salary are in no band and not in the total."""
    x = classify(df, sc, cols).where(F.col("is_management") & F.col(cols.measure).isNotNull()).withColumn("band", salary_band(F.col(cols.measure)))
    g = x.rollup("band").agg(F.count(F.lit(1)).alias("headcount"), F.sum(cols.measure).alias("total_salary"))
    return g.withColumn("band", F.coalesce("band", F.lit("Total")))


def management_ratio(df: DataFrame, sc: Scenario, cols: PanelCols = CLEAN) -> DataFrame:
    """Management positions / unprotected positions per unit."""
    u = _unit(sc, cols)
    x = classify(df, sc, cols)
    g = x.na.drop(subset=[u]).groupBy(u).agg(
        F.count(F.when(F.col("is_management"), F.lit(1))).alias("management"),
        F.count(F.when(~F.col("is_protected"), F.lit(1))).alias("unprotected"))
    return g.withColumn("management_ratio", safe_div("management", "unprotected"))


def plan_from_cuts(cuts: DataFrame, cols: PanelCols, unit: str,
                   phase_edges=(200000.0, 150000.0)) -> DataFrame:
    """A position plan (phase, unit, title, salary) from selected rows;
    phase by salary band; `#` numbers the lines in phase order."""
    s = F.col(cols.measure)
    phase = F.when(s > phase_edges[0], F.lit(1)).when(s >= phase_edges[1], F.lit(2)).otherwise(F.lit(3))
    p = cuts.select(phase.alias("phase"), F.col(unit).alias("department"), F.col(cols.title).alias("title"),
                    F.round(s, 0).alias("salary"), F.col(cols.seq).alias("_seq"))
    return p


def phase_savings(plan: DataFrame, overhead: float) -> DataFrame:
    """Positions and savings per phase, cumulative savings, and the
    cumulative cost with overhead (window over the phases: a handful of rows)."""
    g = plan.groupBy("phase").agg(F.count(F.lit(1)).alias("positions"), F.sum("salary").alias("savings"))
    w = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)
    return (g.withColumn("cumulative", F.sum("savings").over(w))
             .withColumn("cumulative_with_overhead", F.col("cumulative") * F.lit(1.0 + overhead)))


def number_plan(plan: DataFrame) -> DataFrame:
    """Sequential line number in (phase, salary desc, row) order (no salary last)."""
    order = [F.col("phase"), F.col("salary").desc_nulls_last(), F.col("_seq")]
    return prefix.running_count(plan, order, "line").select(*plan.columns, "line")


def untouched_units(df: DataFrame, plan: DataFrame, unit: str) -> DataFrame:
    """Units of the snapshot with no line in the plan."""
    units = df.select(F.col(unit).alias("department")).where(F.col("department").isNotNull()).distinct()
    return units.join(plan.select("department"), "department", "left_anti")
