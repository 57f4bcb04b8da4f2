"""Default lookup values.  Fixed values: they must equal the reference's for
the same results, so they are stated plainly here and nowhere else.  Every
operator takes them as parameters; organisation-specific lists (division
names, title lists) are *not* carried over and must be passed as tables.
"""

# Employee-category codes and their labels.
CATEGORY_CODES = {
    "AS": "Academic Staff",
    "FA": "Faculty",
    "CJ": "University Staff",
    "CL": "University Staff",
    "CP": "University Staff",
    "ET1": "Employee-In-Training",
    "ET2": "Employee-In-Training",
    "ET3": "Employee-In-Training",
    "ET4": "Employee-In-Training",
    "LI": "Limited Appointee",
    "OT1": "Other",
    "OT2": "Other",
    "OT3": "Other",
    "OT4": "Other",
    "OT5": "Other",
    "OT6": "Other",
}

# Category spellings of the newer layout and their labels.
CATEGORY_SPELLINGS = {
    "Employees in Training": "Employee-In-Training",
    "Employee-in-Training": "Employee-In-Training",
    "Limited": "Limited Appointee",
}

CATEGORY_RECODE = {**CATEGORY_CODES, **CATEGORY_SPELLINGS}

# Job groups counted as faculty / instruction / research.
FACULTY_RESEARCH_JOBGROUPS = ["Instruction", "Animal Care Services", "Faculty", "Research"]

# Fixed value: total FTE above which a person's rows in one snapshot are pruned.
MAX_TOTAL_FTE = 1.4

# Columns dropped from raw snapshots.
COLUMNS_TO_DROP = ["annual_fte_adjusted_salary", "pay_basis", "compensation_basis"]

# Raw column renames, older layout.
LEGACY_RENAMES = {
    "annual_full_salary": "current_annual_contracted_salary",
    "full-time_equivalent": "full_time_equivalent",
    "job_code": "jobcode",
    "appointment_type_and_length": "appt_type_length",
    "date_of_hire": "date_of_hire",
}

# Raw column renames, newer layout (two sources may map to one target).
NEW_RENAMES = {
    "annual_full_salary": "current_annual_contracted_salary",
    "annualized_rate_amount": "current_annual_contracted_salary",
    "full-time_equivalent": "full_time_equivalent",
    "fte": "full_time_equivalent",
    "job_code": "jobcode",
    "employee_contract_type": "appt_type_length",
    "date_of_hire": "date_of_hire",
}

# Department-name abbreviation rules, applied in this order
# (regex pattern, replacement) to the lower-cased name.
DEPT_ABBREVIATIONS = [
    (r"\bsch\b", "school"),
    (r"\bmed\b", "medicine"),
    (r"\bmgmt\b", "management"),
    (r"\badmin\b", "administration"),
    (r"\brsrch\b", "research"),
    (r"\bvc\b", "vice chancellor"),
    (r"\bavc\b", "associate vice chancellor"),
    (r"\bedu\b", "education"),
    (r"\bsci\b", "science"),
    (r"\beng\b", "engineering"),
    (r"\bctr\b", "center"),
    (r"\bsrvcs?\b", "services"),
    (r"\bsvcs?\b", "services"),
    (r"\bdept\b", "department"),
    (r"\bprog\b", "program"),
    (r"\binst\b", "institute"),
    (r"\binfo\b", "information"),
    (r"\btech\b", "technology"),
    (r"\bcomm\b", "communication"),
    (r"\bdev\b", "development"),
    (r"\bop\b", "operation"),
    (r"\bops\b", "operations"),
    (r"\bmaint\b", "maintenance"),
    (r"\bfac\b", "facilities"),
    (r"\bpp\b", "physical plant"),
    (r"\bag\b", "agricultural"),
]

# Re-organisation rules (similarity, transfer count).
REORG_SIMILARITY = 0.7
REORG_MIN_TRANSFERS = 20
MASS_RESTRUCTURE_MIN_TRANSFERS = 100
MASS_RESTRUCTURE_SIMILARITY = 0.5
DIVISION_RENAME_SIMILARITY = 0.85
SIGNIFICANT_TRANSFERS = 10
