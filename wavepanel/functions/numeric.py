"""Numeric helpers shared by the library and its SQL oracle.

`round_half_up` is written as plain IEEE arithmetic (`floor(x*10^n+0.5)/10^n`)
so that Spark and any other SQL engine produce bit-identical results for
identical inputs; the engines' own `round` functions differ at exact ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A double of this size or more has no fraction left: rounding changes nothing,
# and `floor` (a BIGINT in Spark) would saturate a little further on.
WHOLE = float(2 ** 52)


def round_half_up(c, n: int = 2) -> Column:
    m = float(10 ** n)
    x = _c(c).cast("double")
    return F.when(F.abs(x * F.lit(m)) < F.lit(WHOLE), F.floor(x * F.lit(m) + F.lit(0.5)) / F.lit(m)).otherwise(x)


def round_sql(expr: str, n: int = 2) -> str:
    m = float(10 ** n)
    return (f"case when abs(({expr}) * {m}) < {WHOLE:.0f} then cast(floor(({expr}) * {m} + 0.5) / {m} as double) "
            f"else cast(({expr}) as double) end")


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (pandas gives inf/NaN; ANSI would raise)."""
    return F.try_divide(_c(a), _c(b))


def pct_change(new, old) -> Column:
    """(new - old) / old * 100, null when old is 0."""
    return F.try_divide(_c(new) - _c(old), _c(old)) * F.lit(100.0)
