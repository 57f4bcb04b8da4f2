"""Transfers between units and re-organisation detection.

Flow: previous unit per row (window by entity) -> pair counts (grouped) ->
similarity on the *distinct pair* table only (pandas UDF) -> rule ladder ->
pair flags joined back to rows (the pair table is small; AQE broadcasts it
when its runtime size allows) -> per-unit counts of entities who ever
really moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..functions import lookups as LK
from ..functions.similarity import name_similarity
from ..functions.text import normalize_dept_name
from .change import previous_value


@dataclass(frozen=True)
class ReorgRules:
    similarity: float = LK.REORG_SIMILARITY
    min_transfers: float = LK.REORG_MIN_TRANSFERS
    mass_transfers: float = LK.MASS_RESTRUCTURE_MIN_TRANSFERS
    mass_similarity: float = LK.MASS_RESTRUCTURE_SIMILARITY
    rename_similarity: float = LK.DIVISION_RENAME_SIMILARITY
    significant: int = LK.SIGNIFICANT_TRANSFERS
    enabled: bool = True


def transfer_pairs(flagged: DataFrame, cols: PanelCols = CLEAN) -> DataFrame:
    """(previous unit, unit) -> number of moves; null units dropped."""
    prev = f"prev_{cols.org}"
    return (flagged.where(F.col("dept_changed"))
                   .na.drop(subset=[prev, cols.org])
                   .groupBy(prev, cols.org).agg(F.count(F.lit(1)).alias("transfer_count")))


def _dept_part(c):
    parts = F.split(F.col(c), " - ", 2)
    return F.when(F.size(parts) == 2, F.element_at(parts, 2))


def detect_reorganizations(pairs: DataFrame, cols: PanelCols = CLEAN,
                           rules: ReorgRules = ReorgRules(), similarity=name_similarity) -> DataFrame:
    """K3: name similarity (`similarity`, a function of two columns of
    normalised names) + volume rules, in order:
    name_change (sim >= thr and n >= min), mass_restructure (n >= mass_n and
    sim >= mass_sim), division_rename (both names have a ' - ' part whose
    similarity >= rename_sim, and n >= min)."""
    prev = f"prev_{cols.org}"
    n = F.col("transfer_count")
    x = (pairs.withColumn("_np", normalize_dept_name(prev))
              .withColumn("_nc", normalize_dept_name(cols.org))
              .withColumn("_pp", normalize_dept_name(_dept_part(prev)))
              .withColumn("_pc", normalize_dept_name(_dept_part(cols.org)))
              .withColumn("_both", _dept_part(prev).isNotNull() & _dept_part(cols.org).isNotNull()))
    x = x.withColumn("name_similarity", similarity("_np", "_nc")).withColumn("_dept_sim", similarity("_pp", "_pc"))
    sim = F.col("name_similarity")
    if not rules.enabled:
        reason = F.lit("")
    else:
        reason = (F.when((sim >= rules.similarity) & (n >= rules.min_transfers), F.lit("name_change"))
                   .when((n >= rules.mass_transfers) & (sim >= rules.mass_similarity), F.lit("mass_restructure"))
                   .when(F.col("_both") & (F.col("_dept_sim") >= rules.rename_similarity)
                         & (n >= rules.min_transfers), F.lit("division_rename"))
                   .otherwise(F.lit("")))
    return (x.withColumn("reorg_reason", reason)
             .withColumn("is_reorg", F.col("reorg_reason") != "")
             .drop("_np", "_nc", "_pp", "_pc", "_both", "_dept_sim"))


def reorg_mapping(flagged_pairs: DataFrame, cols: PanelCols = CLEAN, by: str = "first") -> DataFrame:
    """K4: old unit -> new unit over re-organisation pairs.

    by="first": first new name in key order (what the reference does);
    by="count": the new name with the most moves (what its comment says).
    """
    prev = f"prev_{cols.org}"
    r = flagged_pairs.where(F.col("is_reorg"))
    if by == "count":
        # most moves; ties: first name in key order
        pick = F.min_by(F.col(cols.org), F.struct(-F.col("transfer_count"), F.col(cols.org)))
    else:
        pick = F.min(cols.org)
    return r.groupBy(prev).agg(pick.alias("new_" + cols.org))


def track_transfers(panel: DataFrame, cols: PanelCols = CLEAN, rules: ReorgRules = ReorgRules(),
                    per: str = "row", flagged: DataFrame | None = None,
                    pairs: DataFrame | None = None, similarity=name_similarity) -> dict[str, DataFrame]:
    """K5: rows with transfer flags, per-unit counts, pair table, summary.

    `flagged` (rows with the previous unit) and `pairs` (the detected pair
    table) may be passed in when they are already stored."""
    prev = f"prev_{cols.org}"
    if flagged is None:
        flagged = previous_value(panel, cols, cols.org, per=per)
    if pairs is None:
        pairs = detect_reorganizations(transfer_pairs(flagged, cols), cols, rules, similarity)
    reorg_set = pairs.where(F.col("is_reorg")).select(F.col(prev).alias("_rp"), F.col(cols.org).alias("_rc"),
                                                      F.lit(True).alias("_in"))
    rows = flagged.join(reorg_set, (F.col(prev) == F.col("_rp")) & (F.col(cols.org) == F.col("_rc")), "left")
    in_set = F.coalesce(F.col("_in"), F.lit(False))
    rows = (rows.withColumn("is_reorg_transfer", F.col("dept_changed") & in_set)
                .withColumn("is_real_transfer", F.col("dept_changed") & ~in_set)
                .drop("_rp", "_rc", "_in"))
    movers = rows.where(F.col("is_real_transfer")).select(cols.id).distinct()
    counts = (rows.join(movers, cols.id, "left_semi")
                  .na.drop(subset=[cols.org, cols.date])
                  .groupBy(cols.org, cols.date)
                  .agg(F.count_distinct(cols.id).alias("num_real_transfers")))
    sig = (counts.where(F.col("num_real_transfers") >= rules.significant)
                 .select(F.col(cols.org).alias("_so"), F.col(cols.date).alias("_sd"))
                 .withColumn("has_significant_transfers", F.lit(True)))
    rows = (rows.join(sig, (F.col(cols.org) == F.col("_so")) & (F.col(cols.date) == F.col("_sd")), "left")
                .drop("_so", "_sd")
                .withColumn("has_significant_transfers",
                            F.coalesce(F.col("has_significant_transfers"), F.lit(False)))
                .withColumn("transferred", F.col("dept_changed"))
                .withColumn("DeptHas4PlusTransfers", F.col("has_significant_transfers")))
    summary = (pairs.where(F.col("is_reorg")).groupBy("reorg_reason")
                    .agg(F.count(F.lit(1)).alias("num_pairs"),
                         F.sum("transfer_count").alias("total_employees"),
                         F.bround(F.avg("name_similarity"), 2).alias("avg_similarity")))
    return {"rows": rows, "counts": counts, "pairs": pairs, "summary": summary}


def pair_statistics(pairs: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Moves and pairs by re-organisation flag, and the `top` largest
    real (non-re-organisation) pairs (ties by names)."""
    by_flag = pairs.groupBy("is_reorg").agg(F.count(F.lit(1)).alias("pairs"),
                                            F.sum("transfer_count").alias("moves"))
    real = pairs.where(~F.col("is_reorg"))
    order = [F.col("transfer_count").desc()] + [F.col(c) for c in pairs.columns
                                                if c.startswith("prev_")] + [F.col(pairs.columns[1])]
    return {"by_flag": by_flag, "top_real": real.orderBy(*order).limit(top)}
