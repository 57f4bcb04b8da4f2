"""Cleaning job: raw snapshot rows -> panel (K1, K2; B1-B11, C1-C3, E4-E6).

Whole rows are shuffled twice: the later rows by name for the hire-date fix, and
all rows by entity.  Dedup, group totals and primaries of the pruning work inside
an entity and follow without an exchange; their result is stored.  Input in which
one name holds very many rows is not dealt by entity: totals then come from
aggregates combined map-side and joins (`prune_overallocated`).  The price index
has one row per month and is broadcast; the job dimension is stored first, so
that its size is known when its join is planned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import CLEAN, PanelCols
from ..functions import keys as K
from ..functions.lookups import CATEGORY_RECODE, MAX_TOTAL_FTE
from ..functions.numeric import round_half_up
from ..session import materialize
from ..sources.sinks import BUCKET_SKEW, MIN_BUCKET_ROWS
from .deflate import deflate
from .primary import exact_dedup

DEDUP_COLUMNS = ["id", "Date", "title", "current_annual_contracted_salary",
                 "full_time_equivalent", "division", "department"]


def reconcile_hire_dates(df: DataFrame, cutoff, cols: PanelCols = CLEAN,
                         last: str = "last_name", first: str = "first_name") -> DataFrame:
    """Rows dated >= `cutoff` take the legacy hire date of their name key
    when that key has exactly one distinct non-null hire date before `cutoff`.

    The per-name map grows with the data, so it is a plain join: AQE turns
    it into a broadcast at run time when it is small and keeps a
    shuffle join (with skew splitting) when it is not.  Only rows it may change
    (dated >= `cutoff`, with a name) meet it.
    """
    nk = K.name_key(last, first)
    later = F.coalesce((F.col(cols.date) >= F.lit(cutoff)) & nk.isNotNull(), F.lit(False))
    legacy = (df.where(F.col(cols.date) < F.lit(cutoff))
                .select(nk.alias("_nk"), F.col(cols.hire_date).alias("_h"))
                .where(F.col("_nk").isNotNull())
                .groupBy("_nk")
                .agg(F.min("_h").alias("_legacy_hire"), F.count_distinct("_h").alias("_nh"))
                .where(F.col("_nh") == 1)
                .drop("_nh"))
    j = df.where(later).withColumn("_nk", nk).join(legacy, "_nk", "left")
    fixed = j.withColumn(cols.hire_date, F.coalesce("_legacy_hire", cols.hire_date)).select(*[F.col(f"`{c}`") for c in df.columns])
    return fixed.unionByName(df.where(~later))


def _limited_flag(df: DataFrame, cols: PanelCols, limited_col: str | None) -> Column:
    if limited_col:
        return F.coalesce(F.col(limited_col), F.lit(False))
    return F.coalesce(F.lower(F.col(cols.category)).contains("limited"), F.lit(False))


FACTS = ["_minw", "_pseq", "_pw"]


def with_group_facts(df: DataFrame, cols: PanelCols = CLEAN, limit: float = MAX_TOTAL_FTE,
                     limited_col: str | None = None) -> DataFrame:
    """`df` with the FACTS of its (id, date) group: smallest weight, row number and
    weight of the primary; null in groups within `limit`.  By windows: for rows
    that are dealt by entity already."""
    group = Window.partitionBy(cols.id, cols.date)
    tot, least, primary = _facts(cols, _limited_flag(df, cols, limited_col))
    x = df.withColumns({"_tot": tot.over(group), "_minw": least.over(group), "_p": primary.over(group)})
    over = round_half_up("_tot", 9) > F.lit(limit)
    return x.select(*[F.col(f"`{c}`") for c in df.columns], F.when(over, F.col("_minw")).alias("_minw"),
                    F.when(over, F.col("_p.seq")).alias("_pseq"), F.when(over, F.col("_p.w")).alias("_pw"))


def _facts(cols: PanelCols, limited: Column) -> tuple[Column, Column, Column]:
    """Aggregates of a group: total and smallest weight, the primary's row number and weight."""
    w, m, seq = F.col(cols.weight), F.col(cols.measure), F.col(cols.seq)
    return F.sum(w), F.min(w), F.max_by(F.struct(seq.alias("seq"), w.alias("w")), F.struct(limited.cast("int"), m, -seq))


def prune_overallocated(df: DataFrame, cols: PanelCols = CLEAN, limit: float = MAX_TOTAL_FTE,
                        limited_col: str | None = None, salts: int = 64) -> DataFrame:
    """Prune the rows of (id, date) groups whose total weight exceeds `limit`.

    Primary row: the highest-measure "limited" row if the group has one, else
    the highest-measure row (ties: first row).  The other rows are visited by
    measure descending (limited or not) and kept iff the running kept total
    plus the row's weight stays <= `limit`; skipped rows do not consume
    budget.  A null weight is never admitted, and a null-weight primary
    admits nobody.

    The plan reads `df` three times:
    1. per group the total, smallest weight and primary (one grouped aggregate,
       combined map-side); groups above the limit are kept;
    2. their undecided rows.  With non-negative weights the kept total stays
       within [primary, limit], so zero weights are always admitted, rows that
       do not fit beside the primary never are, and of the rows of one weight w
       at most floor((limit - primary) / w) + 1 can be admitted (one more for
       rounding): the first ones in visiting order.  A top-k inside salted parts
       of (group, weight) and one over the survivors keep only those.  What is
       left is sorted by group and visiting order and streamed past one running
       total (`_admit`): no list of a group's rows, whatever its size, its number
       of weights or their sign;
    3. the rows meet the group's facts and the admitted rows and are filtered.

    Rows that carry their group's facts (`with_group_facts`; not returned) need no
    pass for them, and only the undecided rows meet the admitted ones.
    """
    keys = [cols.id, cols.date]
    w, m, seq = F.col(cols.weight), F.col(cols.measure), F.col(cols.seq)
    known = set(FACTS) <= set(df.columns)
    if known:
        x = df.withColumns({"_id": F.col(cols.id), "_date": F.col(cols.date)})
    else:
        x = df.withColumn("_lim", _limited_flag(df, cols, limited_col))
        tot, least, primary = _facts(cols, F.col("_lim"))
        over = (x.groupBy(*keys).agg(tot.alias("_tot"), least.alias("_minw"), primary.alias("_p"))
                # compared at 1e-9: the order of a distributed floating-point sum must not matter
                .where(round_half_up("_tot", 9) > F.lit(limit))
                .select(F.col(cols.id).alias("_id"), F.col(cols.date).alias("_date"), "_minw",
                        F.col("_p.seq").alias("_pseq"), F.col("_p.w").alias("_pw")))
        same = F.col(cols.id).eqNullSafe(F.col("_id")) & F.col(cols.date).eqNullSafe(F.col("_date"))
    nonneg = F.col("_minw") >= 0
    decided = (F.when(seq == F.col("_pseq"), F.lit(True))
                .when(F.col("_pw").isNull() | w.isNull(), F.lit(False))
                .when(nonneg & (F.col("_pw") + w > F.lit(limit)), F.lit(False))
                .when(nonneg & (w == 0), F.lit(True)))
    most = F.when(nonneg, F.floor((F.lit(limit) - F.col("_pw")) / w) + F.lit(2))
    visit = [F.col("_m").desc_nulls_last(), F.col("_seq")]
    met = x.where(F.col("_pseq").isNotNull()) if known else x.join(over, same)
    c = (met.where(decided.isNull())
          .select("_id", "_date", "_pw", w.cast("double").alias("_w"), m.alias("_m"), seq.cast("long").alias("_seq"), most.alias("_most"),
                  F.pmod(F.xxhash64(seq), F.lit(salts)).alias("_salt")))
    for part in (["_id", "_date", "_w", "_salt"], ["_id", "_date", "_w"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*visit))
        c = c.withColumn("_r", rank).where(F.col("_most").isNull() | (F.col("_r") <= F.col("_most")))
    c = (c.select("_id", "_date", F.col("_pw").cast("double").alias("_pw"), "_w", "_m", "_seq")
          .repartition("_id", "_date").sortWithinPartitions("_id", "_date", *visit).select("_id", "_date", "_pw", "_w", "_seq"))
    types = c.schema
    admitted = c.mapInArrow(_admit(limit), T.StructType([types["_id"], types["_date"], types["_seq"]])).toDF("_aid", "_adate", "_aseq")
    mine = (F.col(cols.id).eqNullSafe(F.col("_aid")) & F.col(cols.date).eqNullSafe(F.col("_adate")) & (seq == F.col("_aseq")))
    if known:
        rest = [F.col(f"`{k}`") for k in df.columns if k not in FACTS]
        return (x.where(F.col("_pseq").isNull() | F.coalesce(decided, F.lit(False))).select(*rest)
                .unionByName(met.where(decided.isNull()).join(admitted, mine).select(*rest)))
    stays = F.col("_pseq").isNull() | F.coalesce(decided, F.col("_aseq").isNotNull())
    return x.join(over, same, "left").join(admitted, mine, "left").where(stays).select(*[F.col(f"`{k}`") for k in df.columns])


def _admit(limit: float):
    """Rows (group keys, primary's weight, weight, row number), sorted by group and
    visiting order -> the rows that fit: one running total per group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, 0.0
        for batch in batches:
            ids, dates, first, weights = (batch.column(i).to_pylist() for i in range(4))
            kept = []
            for k, weight in enumerate(weights):
                if group != (ids[k], dates[k]):
                    group, total = (ids[k], dates[k]), first[k]
                if total + weight <= limit:
                    total += weight
                    kept.append(k)
            yield batch.select([0, 1, 4]).take(pa.array(kept, pa.int32()))

    return run


def add_analysis_flags(df: DataFrame, cols: PanelCols = CLEAN, faculty_label: str = "Faculty",
                       jobgroups=None, teaching_group: str = "Teaching and Learning",
                       non_teaching_titles=()) -> DataFrame:
    """`IsFacultyDivision` (division has any faculty row) and
    `IsFacResTeachingTitle` (job group in the list and not a non-teaching
    title of the teaching group)."""
    from ..functions.lookups import FACULTY_RESEARCH_JOBGROUPS
    jobgroups = list(jobgroups or FACULTY_RESEARCH_JOBGROUPS)
    fac_divs = (df.where(F.col(cols.category) == F.lit(faculty_label))
                  .select(F.col(cols.division).alias("_fd")).where(F.col("_fd").isNotNull())
                  .distinct().withColumn("IsFacultyDivision", F.lit(True)))
    j = df.join(fac_divs, F.col(cols.division) == F.col("_fd"), "left").drop("_fd")
    jg = F.col(cols.jobgroup)
    excl = (jg == F.lit(teaching_group)) & F.col(cols.title).isin(list(non_teaching_titles)) \
        if non_teaching_titles else F.lit(False)
    return (j.withColumn("IsFacultyDivision", F.coalesce(F.col("IsFacultyDivision"), F.lit(False)))
             .withColumn("IsFacResTeachingTitle",
                         F.coalesce(jg.isin(jobgroups) & ~F.coalesce(excl, F.lit(False)), F.lit(False))))


def attach_job_dimension(df: DataFrame, jobs: DataFrame, cols: PanelCols = CLEAN,
                         key: str = "jobcode") -> DataFrame:
    """C2 + B11: left join on the job code where null matches null.

    The job dimension has one row per job code (first row kept).  It is not
    hinted: AQE broadcasts it when its runtime size is under the broadcast
    threshold and keeps a shuffle join otherwise.
    """
    jobs = jobs.withColumnRenamed(key, "_jk")
    j = df.join(jobs, F.col(cols.jobcode).eqNullSafe(F.col("_jk")), "left").drop("_jk")
    if "job_group" in jobs.columns:
        return j.withColumn("jobgroup", F.col("job_group"))
    return j.withColumn("jobgroup", F.lit(None).cast("string"))


def names_are_even(raw: DataFrame, last: str = "last_name", first: str = "first_name") -> bool:
    """Whether rows dealt by name make no partition much larger than the others:
    an entity, whose rows share a name, may then be the work of one task."""
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.xxhash64(*[F.upper(F.coalesce(F.col(c).cast("string"), F.lit("NAN"))) for c in (last, first)])
    sizes = (raw.groupBy(F.pmod(name, F.lit(parts)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first())
    return (sizes["most"] or 0) <= max(BUCKET_SKEW * (sizes["rows"] or 0) / parts, MIN_BUCKET_ROWS)


def clean_panel(raw: DataFrame, price: DataFrame | None, jobs: DataFrame | None = None,
                hire_cutoff=None, category_map=None, division_map=None,
                cols: PanelCols = CLEAN, limit: float = MAX_TOTAL_FTE,
                price_date: str = "Date", price_value: str = "CPI_2021_Index",
                price_mode: str = "latest", store: bool = True) -> DataFrame:
    """K1: the reference's cleaning order.

    With `store` the rows are dealt by entity (unless one name holds very many of
    them) and the deduplicated ones, with the facts the pruning needs, are written
    once to the shared folder, as is the job dimension; without it the whole job is
    one lazy plan.

    hire-date fix -> id -> category recode -> exact dedup -> over-allocation
    pruning -> job-code normalisation -> division recode -> derived columns ->
    price index -> job dimension.
    """
    df = raw
    if hire_cutoff is not None:
        df = reconcile_hire_dates(df, hire_cutoff, cols)
    df = df.withColumn(cols.id, K.entity_id("last_name", "first_name", cols.hire_date))
    df = df.withColumn(cols.category, K.recode(cols.category,
                                               CATEGORY_RECODE if category_map is None else category_map))
    dedup_keys = [c for c in DEDUP_COLUMNS if c in df.columns]
    dealt = store and names_are_even(raw)
    df = exact_dedup(df.repartition(F.col(cols.id)) if dealt else df, dedup_keys, cols.seq)
    if dealt:
        df = with_group_facts(df, cols, limit)
    if store:
        df = materialize(df, "deduplicated")
    df = prune_overallocated(df, cols, limit)
    df = df.withColumn(cols.jobcode, K.normalize_jobcode(cols.jobcode))
    df = df.withColumn(cols.division, K.recode(cols.division, division_map or {}))
    df = (df.withColumn(cols.org, K.org_key(cols.division, cols.department))
            .withColumn("id_jobcode", F.concat(F.col(cols.id), F.lit("_"), F.col(cols.jobcode)))
            .withColumn("FullTime", F.coalesce(F.col(cols.weight) == 1, F.lit(False)))
            .withColumn("JobGroupCode", K.job_group_prefix(cols.jobcode))
            .withColumn("JobNumber", K.job_number(cols.jobcode)))
    if price is not None:
        df = deflate(df, price, cols, idx_date=price_date, idx_val=price_value, mode=price_mode,
                     carry=[c for c in ("CPI", "CPI_2021_Index") if c in price.columns])
    if jobs is not None:
        df = attach_job_dimension(df, materialize(jobs, "jobs") if store else jobs, cols)
    else:
        df = df.withColumn("jobgroup", F.lit(None).cast("string"))
    return df


def load_panel(clean: DataFrame, cols: PanelCols = CLEAN, min_fte: float = 0.01) -> DataFrame:
    """K2: the cleaned panel restricted to weight > `min_fte` (strict)."""
    return clean.where(F.col(cols.weight) > F.lit(min_fte))
