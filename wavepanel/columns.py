"""Column-name contract of a panel.

Every operator takes a :class:`PanelCols` so the same code runs on the
cleaned panel (reference names) and on any other table with the same roles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PanelCols:
    id: str = "id"
    date: str = "Date"
    division: str = "division"
    department: str = "department"
    org: str = "division_department"
    title: str = "title"
    category: str = "employee_category"
    jobcode: str = "jobcode"
    jobgroup: str = "jobgroup"
    measure: str = "current_annual_contracted_salary"
    weight: str = "full_time_equivalent"
    weighted: str = "fte_adjusted_salary"
    index: str = "2021_Index"
    real_weighted: str = "FTE_Adjusted_Salary_2021_Dollars"
    real_measure: str = "Real_Salary_2021_Dollars"
    hire_date: str = "date_of_hire"
    div_type: str = "div_type"
    seq: str = "_row_seq"

    def with_(self, **kw) -> "PanelCols":
        return replace(self, **kw)


# Names used by the cleaned panel (the reference's target schema).
CLEAN = PanelCols()

# Names of the `panel` fixture view built from the driver's tables
# (FIXTURES.md 2.1); real measures are added by `deflate`.
FIXTURE = PanelCols(
    date="snapshot_date", category="category", jobgroup="job_group",
    measure="salary", weight="fte", weighted="pay", index="idx",
    real_weighted="real_pay", real_measure="real_salary", seq="row_id",
    org="org", hire_date="hire_date",
)
