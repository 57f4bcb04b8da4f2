"""The full analysis bundle (K9): every group metric and the transfer
analysis over one filtered panel, as a dict of lazy DataFrames.

The panel feeds several consumers, so it is stored once (Parquet in the
shared checkpoint folder) and each result plan starts from the stored copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import CLEAN, PanelCols
from ..session import materialize
from .aggregate import group_proportion, pivot_by_date
from .change import baseline_changes, previous_value
from .clean import add_analysis_flags, load_panel
from ..functions.similarity import name_similarity
from .transfers import ReorgRules, detect_reorganizations, track_transfers, transfer_pairs


def run_full_analysis(clean: DataFrame, cols: PanelCols = CLEAN, min_fte: float = 0.01,
                      faculty_label: str = "Faculty", jobgroups=None, min_date=None,
                      rules: ReorgRules = ReorgRules(), store: bool = True, similarity=name_similarity,
                      dates: list | None = None) -> dict[str, DataFrame]:
    """K9: load (weight > min_fte) -> flags -> proportions, FTE pivot, FTE
    changes and their two pivots -> transfers, counts, pairs, summary."""
    data = add_analysis_flags(load_panel(clean, cols, min_fte), cols, faculty_label, jobgroups)
    if store:
        data = materialize(data, "analysis_panel")
    fte = (data.na.drop(subset=[cols.jobgroup])
               .groupBy("IsFacultyDivision", cols.jobgroup, cols.date)
               .agg(F.sum(cols.weight).alias(cols.weight)))
    changes = baseline_changes(fte, ["IsFacultyDivision", cols.jobgroup], cols.date, cols.weight)
    recent = changes if min_date is None else changes.where(F.col(cols.date) >= F.lit(min_date))

    def flag_pivot(value: str) -> DataFrame:
        return recent.groupBy(cols.jobgroup).pivot("IsFacultyDivision", [False, True]).agg(F.avg(value))

    # read by four of the frames: rows with their previous unit, and the detected pairs
    flagged = previous_value(data, cols, cols.org)
    flagged = materialize(flagged, "analysis_flagged") if store else flagged
    pairs = detect_reorganizations(transfer_pairs(flagged, cols), cols, rules, similarity)
    pairs = materialize(pairs, "analysis_pairs") if store else pairs
    t = track_transfers(data, cols, rules, flagged=flagged, pairs=pairs)
    return {
        "salary_data": t["rows"],
        "dept_jobgroup_prop": group_proportion(data, cols),
        "dept_fte_pivot": pivot_by_date(data, [cols.division, cols.department], cols, dates=dates),
        "fte_changes": changes,
        "fte_change_pivot": flag_pivot("fte_change"),
        "fte_pct_change_pivot": flag_pivot("fte_pct_change"),
        "transfer_counts": t["counts"],
        "transfer_pairs": t["pairs"],
        "reorg_summary": t["summary"],
    }
