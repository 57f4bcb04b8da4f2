"""Key and code expressions (B1, B2, B4-B7, B9).  All JVM-side built-ins."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entity_id(last, first, hire_date) -> Column:
    """B1: first 12 hex chars of md5('LAST|FIRST|YYYY-MM-DD').

    Names are upper-cased but not trimmed; a missing name becomes the text
    'NAN' and a missing hire date an empty string (what the reference's
    string conversion of a missing value produces).
    """
    hire = F.coalesce(F.substring(_c(hire_date).cast("string"), 1, 10), F.lit(""))
    key = F.concat(F.upper(F.coalesce(_c(last).cast("string"), F.lit("NAN"))), F.lit("|"),
                   F.upper(F.coalesce(_c(first).cast("string"), F.lit("NAN"))), F.lit("|"), hire)
    return F.substring(F.md5(key), 1, 12)


def name_key(last, first) -> Column:
    """B2: UPPER(TRIM(last)) | UPPER(TRIM(first)); null if either is null."""
    return F.concat(F.upper(F.trim(_c(last))), F.lit("|"), F.upper(F.trim(_c(first))))


def normalize_jobcode(c, suffixes=("U", "A", "X", "N")) -> Column:
    """A 6-char code ending in one of `suffixes` loses the suffix."""
    c = _c(c)
    return F.when((F.length(c) == 6) & F.substring(c, 6, 1).isin(list(suffixes)),
                  F.substring(c, 1, 5)).otherwise(c)


def org_key(division, department, sep: str = " - ") -> Column:
    """B7: 'division - department'; null if either part is null (not concat_ws)."""
    return F.concat(_c(division), F.lit(sep), _c(department))


def recode(c, mapping: dict[str, str]) -> Column:
    """Exact-match replacement, unmatched values (and nulls) kept."""
    if not mapping:
        return _c(c)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(m, _c(c)), _c(c))


def job_group_prefix(jobcode) -> Column:
    """First two characters of the job code."""
    return F.substring(_c(jobcode), 1, 2)


def job_number(jobcode) -> Column:
    """Job code after its first two characters."""
    return F.expr("substring({0}, 3)".format(jobcode)) if isinstance(jobcode, str) else \
        F.substring(jobcode, 3, 1 << 20)
