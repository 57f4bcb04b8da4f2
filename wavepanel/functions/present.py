"""Presentation formats (J10): display strings for report tables.

Whole amounts are rounded half away from zero, decimals half to even on the
exact binary value; Python's formatter rounds both half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """$1,234 (no decimals)."""
    return F.concat(F.lit("$"), F.format_number(F.round(_c(c), 0), 0))


def signed_money(c) -> Column:
    """$+1,234 / $-1,234."""
    v = _c(c)
    return F.concat(F.when(v < 0, F.lit("$-")).otherwise(F.lit("$+")), F.format_number(F.abs(F.round(v, 0)), 0))


def signed_number(c, digits: int = 0) -> Column:
    """+1,234 / -1,234.5."""
    v = _c(c)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("+")), F.format_number(F.abs(v), digits))


def signed_pct(c, digits: int = 1, missing: str = "New") -> Column:
    """+1.2% ; a null percentage (zero base) shows `missing` ("New"/"Removed")."""
    v = _c(c)
    return F.when(v.isNull(), F.lit(missing)).otherwise(
        F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("+")), F.format_number(F.abs(v), digits), F.lit("%")))


def month_label(c, long: bool = False) -> Column:
    """2025-09 or 'September 2025'."""
    return F.date_format(_c(c), "MMMM yyyy" if long else "yyyy-MM")
