"""Text expressions (B18-B20, dept-name normalisation).  JVM-side regexes.

Patterns run with `(?U)` so that `\\w`, `\\b` and `\\s` are Unicode-aware,
as in Python's `re` on `str`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import DEPT_ABBREVIATIONS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_dept_name(c, rules=DEPT_ABBREVIATIONS) -> Column:
    """Lower-case, expand abbreviations in order, punctuation -> space,
    collapse whitespace, strip.  Null -> '' (non-text has no name)."""
    s = F.lower(_c(c))
    for pat, rep in rules:
        s = F.regexp_replace(s, "(?U)" + pat, rep)
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.coalesce(s, F.lit(""))


def normalize_dept_name_sql(expr: str, rules=DEPT_ABBREVIATIONS) -> str:
    """The same normalisation as portable SQL (ASCII word classes)."""
    s = f"lower({expr})"
    for pat, rep in rules:
        s = f"regexp_replace({s}, '{pat}', '{rep}', 'g')"
    s = f"regexp_replace({s}, '[^\\w\\s]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"coalesce(trim({s}), '')"


def keyword_category(c, table: list[tuple[str, list[str]]], default: str = "Other") -> Column:
    """First category (in priority order) one of whose keywords is a
    case-insensitive substring of the text; else `default`."""
    low = F.lower(_c(c))
    expr = None
    for category, words in table:
        cond = None
        for w in words:
            hit = F.coalesce(low.contains(w.lower()), F.lit(False))
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def keyword_category_sql(expr: str, table: list[tuple[str, list[str]]], default: str = "Other") -> str:
    whens = []
    for category, words in table:
        cond = " or ".join(f"coalesce(contains(lower({expr}), '{w.lower()}'), false)" for w in words)
        whens.append(f"when {cond} then '{category}'")
    return f"case {' '.join(whens)} else '{default}' end"


def matches_ci(c, pattern: str) -> Column:
    """Case-insensitive regex match (e.g. an alternation), null -> false."""
    return F.coalesce(_c(c).rlike("(?i)" + pattern), F.lit(False))


def classify_lookup(c, mapping: dict[str, str], default: str = "Other") -> Column:
    """Value -> class through a lookup, unmatched and null -> default.

    For a small fixed list this is a map literal inside the projection; a
    lookup that grows with the data belongs in a (broadcast) join instead.
    """
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(c)), F.lit(default))


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive literal substring test, null -> false."""
    return F.coalesce(F.lower(_c(c)).contains(needle.lower()), F.lit(False))


def status_label(is_current, last_seen) -> Column:
    """B21: 'Current' or 'Last seen YYYY-MM'."""
    return F.when(_c(is_current), F.lit("Current")).otherwise(
        F.concat(F.lit("Last seen "), F.date_format(_c(last_seen), "yyyy-MM")))
